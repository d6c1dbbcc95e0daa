"""From files to entities and edges: all symbols first, then references by join, so that no order of files matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions.text import content_hash
from siftwell.operators import changes, documents, entities, resolve
from siftwell.sources import parsers


def entity_id(qualified_name):
    """The id of an entity: a hash of its qualified name, the same in every run."""
    return F.substring(F.sha2(qualified_name, 256), 1, 16)


def _entities(df: DataFrame, now) -> DataFrame:
    """Fill up to the schema; one row per qualified name."""
    want = [c.split()[0] for c in schemas.ENTITIES.split(", ")]
    x = df.where("qualified_name is not null").dropDuplicates(["qualified_name"])
    x = x.withColumn("id", entity_id(F.col("qualified_name"))).withColumn("hash", content_hash(F.col("content")))
    x = x.withColumn("created_at", F.lit(now).cast("timestamp")).withColumn("updated_at", F.lit(now).cast("timestamp"))
    kinds = dict(part.split(" ", 1) for part in schemas.ENTITIES.split(", "))
    return x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in want])


def code_entities(files: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Entities and edges (source_id, target_id, relationship, weight) of source files (path, content): files, their symbols,
    members included, containment, imports and inheritance. Edges to what is not there are left out."""
    symbols = parsers.code(files)
    own = symbols.where(~F.col("type").isin("import", "error"))
    body = own.join(files.select("path", "content"), "path")
    lines = F.split("content", "\n")
    text = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)), "\n")
    s = body.select(
        "type", "name", F.concat_ws("::", "path", "qualified_name").alias("qualified_name"), text.alias("content"), F.coalesce("doc", "signature").alias("summary"),
        F.create_map(F.lit("language"), "language", F.lit("signature"), F.coalesce("signature", F.lit(""))).alias("metadata"), F.col("path").alias("file_path"), "start_line", "end_line",
    )
    n = own.groupBy("path").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 20), ", ").alias("names"))
    f = files.where("content is not null").select("path", "content").join(n, "path", "left").select(
        F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qualified_name"),
        "content", F.concat(F.lit("Defines "), "names").alias("summary"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"),
    )
    ents = _entities(s.unionByName(f, allowMissingColumns=True), now)
    raw = parsers.code_edges(symbols)
    inner = raw.where("relationship = 'CONTAINS'").select(entity_id(F.col("source")).alias("source_id"), entity_id(F.col("target")).alias("target_id"), "relationship", "weight")
    folder = F.regexp_replace("source", "/?[^/]+$", "")
    target = F.regexp_replace("target", r"^(\./)+", "")
    path = F.when(F.col("target").startswith("."), F.concat_ws("/", F.when(folder != "", folder), target)).otherwise(F.replace("target", F.lit("."), F.lit("/")))
    imports = raw.where("relationship = 'IMPORTS'").select(entity_id(F.col("source")).alias("source_id"), path.alias("path"))
    more = imports.unionByName(imports.withColumn("path", F.concat("path", F.lit(".py"))))
    hit = resolve.imports(more, ents).select("source_id", "target_id", F.lit("IMPORTS").alias("relationship"), F.lit(1.0).alias("weight"))
    refs = raw.where("relationship = 'EXTENDS'").select(F.concat_ws("|", "source", "target").alias("ref_id"), F.col("target").alias("text"), "source")
    up = resolve.references(refs.select("ref_id", "text"), ents).join(refs, "ref_id").select(entity_id(F.col("source")).alias("source_id"), F.col("entity_id").alias("target_id"), F.lit("EXTENDS").alias("relationship"), F.lit(1.0).alias("weight"))
    return ents, inner.unionByName(hit).unionByName(up).where("source_id <> target_id").distinct()


def document_entities(docs: DataFrame, known: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of Markdown documents (path, content): documents, sections and requirements, containment, and DOCUMENTS
    edges to the entities of ``known`` that a section refers to."""
    sec = parsers.markdown(docs)
    q = F.concat_ws("::", "path", "section_id")
    s = sec.select(F.when(F.col("level") == 0, "section").otherwise("section").alias("type"), F.col("title").alias("name"), q.alias("qualified_name"), "content", F.col("title").alias("summary"), F.col("path").alias("file_path"), "start_line", "end_line")
    title = sec.where("level = 1").groupBy("path").agg(F.min_by("title", "start_line").alias("title"))
    d = docs.where("content is not null").select("path", "content").join(title, "path", "left").select(
        F.lit("document").alias("type"), F.coalesce("title", F.element_at(F.split("path", "/"), -1)).alias("name"), F.col("path").alias("qualified_name"), "content", F.col("title").alias("summary"), F.col("path").alias("file_path")
    )
    req = documents.requirements(sec.select(q.alias("section_id"), "title", "content"))
    r = req.select(F.lit("requirement").alias("type"), F.col("title").alias("name"), F.concat_ws("::", "section_id", F.col("id")).alias("qualified_name"), F.col("description").alias("content"), F.create_map(F.lit("priority"), F.coalesce("priority", F.lit(""))).alias("metadata"))
    ents = _entities(s.unionByName(d, allowMissingColumns=True).unionByName(r, allowMissingColumns=True), now)
    contains, one = F.lit("CONTAINS").alias("relationship"), F.lit(1.0).alias("weight")
    up = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat_ws("::", "path", "parent"))
    edges = sec.select(entity_id(up).alias("source_id"), entity_id(q).alias("target_id"), contains, one)
    edges = edges.unionByName(req.select(entity_id(F.col("section_id")).alias("source_id"), entity_id(F.concat_ws("::", "section_id", F.col("id"))).alias("target_id"), contains, one))
    refs = documents.code_references(sec.select(q.alias("key"), "content"), "key", "content").select("key", F.concat_ws("|", "key", "ref").alias("ref_id"), F.col("ref").alias("text"))
    hit = resolve.references(refs.select("ref_id", "text"), known).join(refs.select("ref_id", "key"), "ref_id")
    return ents, edges.unionByName(hit.select(entity_id(F.col("key")).alias("source_id"), F.col("entity_id").alias("target_id"), F.lit("DOCUMENTS").alias("relationship"), F.lit(0.9).alias("weight"))).where("source_id <> target_id").distinct()


def pdf_entities(pages: DataFrame, now, least: int = 50, longest: int = 100_000) -> DataFrame:
    """Entities of extracted PDF pages (path, page, text): the document, with its first ``longest`` characters as content, and
    every page of at least ``least`` characters as a section. The extraction itself is left to a provider."""
    row = F.struct("page", F.coalesce("text", F.lit("")).alias("t"))
    d = pages.groupBy("path").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["t"]), "\n"), 1, longest).alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    doc = d.select(F.lit("document").alias("type"), name.alias("name"), F.col("path").alias("qualified_name"), "content", F.col("path").alias("file_path"))
    sec = pages.where(F.length("text") >= least).select(F.lit("section").alias("type"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("name"), F.concat_ws("::page-", "path", F.col("page").cast("string")).alias("qualified_name"), F.col("text").alias("content"), F.col("path").alias("file_path"))
    return _entities(doc.unionByName(sec), now)


def incremental(old: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to be indexed anew, and paths whose entities have to go, between the indexed state (path, md5) and a tree (path, md5, ...)."""
    state = changes.diff(old, files, "path", "md5")
    fresh = files.join(state.where("state in ('added', 'modified')").select("path"), "path", "left_semi")
    return fresh, state.where("state in ('deleted', 'modified')").select("path")


def apply(known: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities without those of files that went or changed, and with the new ones, which keep ids and times of creation."""
    left = known.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*known.columns)
    born = known.select("id", F.col("created_at").alias("_b"))
    new = fresh.join(born, "id", "left").withColumn("created_at", F.coalesce("_b", "created_at")).select(*known.columns)
    return entities.upsert(left, new, ["qualified_name"])
