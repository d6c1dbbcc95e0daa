"""Resolving references to entities, linking and merging like entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.joins import lookup
from siftwell.operators.vectors import dot, similar_pairs
from siftwell.runtime import materialize

#: Suffixes that an import path may lack, in the order in which they are tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def references(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """ref_id, entity_id, tier of references (ref_id, text): by qualified name, then as a file, as a class, interface or
    type, as a function or method, and last as anything of that name; the least id of the first tier that has one.

    One equi-join per kind of key; the name is joined once for all tiers that use it.
    """
    e = entities.select("id", "type", "name", "qualified_name", "file_path")
    r = refs.select("ref_id", "text").where(F.col("text").isNotNull())
    q = r.join(e.select(F.col("qualified_name").alias("text"), "id"), "text").select("ref_id", "id", F.lit(1).alias("tier"))
    f = r.join(e.where("type = 'file'").select(F.col("file_path").alias("text"), "id"), "text").select("ref_id", "id", F.lit(2).alias("tier"))
    kind = F.when(F.col("type").isin("class", "interface", "type"), 3).when(F.col("type").isin("function", "method"), 4).otherwise(5)
    bare = r.withColumn("text", F.regexp_replace("text", r"\(\)$", ""))
    n = bare.join(e.select(F.col("name").alias("text"), "id", kind.alias("tier")), "text").select("ref_id", "id", "tier")
    best = q.unionByName(f).unionByName(n).groupBy("ref_id").agg(F.min(F.struct("tier", "id")).alias("x"))
    return best.select("ref_id", F.col("x.id").alias("entity_id"), "x.tier")


def report(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """References with the entity that they resolve to, null where there is none."""
    return refs.join(references(refs, entities), "ref_id", "left")


def imports(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id of imports (source_id, path without suffix): the file of the first suffix that has one."""
    tries = paths.select("source_id", "path", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("nth", "suffix")).withColumn("file_path", F.concat("path", "suffix"))
    files = entities.where("type = 'file'").select("file_path", "id")
    hit = tries.join(files, "file_path").groupBy("source_id", "path").agg(F.min(F.struct("nth", "id")).alias("x"))
    return hit.select("source_id", "path", F.col("x.id").alias("target_id"))


def configures(keys: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from configuration keys (id, name) to other entities of the same name."""
    other = entities.select(F.col("id").alias("target_id"), "name")
    return keys.select(F.col("id").alias("source_id"), "name").join(other, "name").where("source_id <> target_id").select("source_id", "target_id", F.lit("CONFIGURES").alias("relationship")).distinct()


def semantic_links(neighbours: DataFrame, edges: DataFrame, threshold: float = 0.75, most: int = 5) -> DataFrame:
    """New RELATES_TO edges from neighbour lists (entity_id, other, score): at least ``threshold``, at most ``most`` per
    entity, each pair once (from the lesser id), none that are linked already."""
    w = Window.partitionBy("entity_id").orderBy(F.col("score").desc(), "other")
    n = neighbours.where((F.col("score") >= threshold) & (F.col("entity_id") != F.col("other")))
    n = n.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    pair = n.groupBy(F.least("entity_id", "other").alias("source_id"), F.greatest("entity_id", "other").alias("target_id")).agg(F.max("score").alias("weight"))
    known = edges.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).distinct()
    return pair.join(known, ["source_id", "target_id"], "left_anti").withColumn("relationship", F.lit("RELATES_TO"))


def prune_links(edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Edges without RELATES_TO links that are too weak."""
    return edges.where((F.col("relationship") != "RELATES_TO") | (F.coalesce("weight", F.lit(1.0)) >= least))


def duplicate_groups(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id, primary_id of similar pairs (a, b, score): greedy in the order of ids. An entity that no lesser primary has
    taken becomes a primary and takes its similar entities that are not taken yet.

    Round by round the entities that have no undecided lesser neighbour take their neighbours, which gives the
    entities that a sequential pass takes. All others are primaries, and the least of them takes an entity.
    """
    e = pairs.where((F.col("score") >= threshold) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    every = e = materialize(e)
    lost = None
    while not e.isEmpty():
        primary = e.select(F.col("lo").alias("id")).distinct().join(e.select(F.col("hi").alias("id")).distinct(), "id", "left_anti")
        primary = materialize(primary)
        taken = materialize(e.join(primary.select(F.col("id").alias("lo")), "lo").select(F.col("hi").alias("id")).distinct())
        lost = taken if lost is None else lost.unionByName(taken)
        gone = primary.unionByName(taken)
        e = materialize(e.join(gone.select(F.col("id").alias("lo")), "lo", "left_anti").join(gone.select(F.col("id").alias("hi")), "hi", "left_anti"))
    if lost is None:
        return pairs.select(F.col("a").alias("id"), F.col("a").alias("primary_id")).limit(0)
    led = every.join(lost.select(F.col("id").alias("lo")), "lo", "left_anti")
    led = materialize(led.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("primary_id")))
    return led.unionByName(led.select(F.col("primary_id").alias("id"), "primary_id").distinct())


def vector_groups(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """As ``duplicate_groups``, of all pairs of ``vectors`` (entity_id, embedding) at or above the threshold.

    Entities with the same usable vectors have the same similar entities and go to the same primary, so that of each
    such class only the least id is compared; a class of copies is a group, however large, without its pairs.
    """
    square = dot(F.col("embedding"), F.col("embedding"))
    v = vectors.where(F.col("entity_id").isNotNull() & (square > 0) & (square < float("inf")))
    own = v.groupBy("entity_id").agg(F.sort_array(F.collect_set("embedding")).alias("set"))
    own = materialize(own.select("entity_id", "set", F.sha2(F.to_json("set"), 256).alias("class")))
    classes = materialize(own.groupBy("class").agg(F.min("entity_id").alias("id"), F.count("*").alias("n")))
    least = own.join(classes.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", F.explode("set").alias("embedding"))
    groups = duplicate_groups(similar_pairs(least, threshold), threshold)
    led = classes.join(groups, "id", "left").withColumn("primary_id", F.coalesce("primary_id", F.when(F.col("n") > 1, F.col("id"))))
    led = materialize(led.where("primary_id is not null").select("class", "primary_id", "n"))
    return lookup(own.select("class", F.col("entity_id").alias("id")), led, ["class"], "n").select("id", "primary_id")


def merge(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Entities after merging groups (id, primary_id): only primaries stay, with the other names as aliases in their metadata."""
    from siftwell.operators.entities import merge_metadata

    names = groups.where("id <> primary_id").join(entities.select("id", "name"), "id").groupBy(F.col("primary_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("_a"))
    left = entities.join(groups.where("id <> primary_id").select("id"), "id", "left_anti").join(names, "id", "left")
    alias = F.concat_ws(",", F.col("metadata")["aliases"], F.col("_a"))
    return left.withColumn("metadata", F.when(F.col("_a").isNotNull(), merge_metadata(F.col("metadata"), F.create_map(F.lit("aliases"), alias))).otherwise(F.col("metadata"))).select(*entities.columns)


def aliases(entities: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """query_id, id, similarity: entities whose name is like a given one (query_id, name). Joined on shared character pairs,
    of which a pair of names that reaches ``least`` shares that part at least; a name's rarest pairs suffice to find it."""
    from siftwell.functions.text import bigrams, name_similarity

    q = names.select("query_id", F.col("name").alias("qname"), bigrams(F.col("name")).alias("qb"))
    e = entities.select("id", "name", bigrams(F.col("name")).alias("b"))
    # any n - ceil(least n) + 1 of a name's pairs, in one common order, meet those of every name so similar
    head = f"slice(sort_array(%s), 1, size(%s) - cast(ceil({least} * size(%s)) as int) + 1)"
    x = q.select("*", F.explode(F.expr(head % ("qb", "qb", "qb"))).alias("k")).where(F.size("qb") > 0)
    y = e.select("*", F.explode(F.expr(head % ("b", "b", "b"))).alias("k")).where(F.size("b") > 0)
    hit = x.join(y, "k").select("query_id", "qname", "id", "name").distinct()
    return hit.withColumn("similarity", name_similarity(F.col("qname"), F.col("name"))).where(F.col("similarity") >= least).select("query_id", "id", "name", "similarity")
