"""Packing results into a budget of tokens: prefixes, greedy picks, expansion and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import estimate_tokens

#: Categories of entity types, in the order in which they are put out.
CATEGORIES = {
    "code": ("function", "method", "class", "interface", "type", "file", "module", "variable", "constant"),
    "documentation": ("document", "section", "requirement", "feature", "concept"),
    "conversation": ("session", "message", "decision", "summary"),
}
ORDER = ("code", "documentation", "conversation", "other")
#: Tokens kept back for the list of sources, and sources listed.
SOURCES_RESERVE, SOURCES_SHOWN = 200, 10


def category(type_: Column) -> Column:
    out = F.lit("other")
    for name, types in CATEGORIES.items():
        out = F.when(type_.isin(*types), name).otherwise(out)
    return out


def prefix(df: DataFrame, by: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The longest run of rows from the first on whose tokens fit the budget; adds used."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def greedy(df: DataFrame, by: str, order: list[str], tokens: str, budget: int, payload: list[str]) -> DataFrame:
    """Rows taken in order if they still fit, others passed over. ``order`` are ascending columns; a query's
    candidates are folded in one row, so they should be bounded (a top-k)."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(tokens).cast("long").alias("t"), F.struct(*payload).alias("p"))
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    empty = F.expr("slice(rows, 1, 0)")
    start = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["t"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["t"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken")
        )

    folded = rows.select(by, F.aggregate("rows", start, take).alias("x"))
    return folded.select(by, F.posexplode("x.taken").alias("pos", "r")).select(by, "pos", F.col("r.t").alias(tokens), *[F.col(f"r.p.{c}").alias(c) for c in payload])


def expand(results: DataFrame, edges: DataFrame, entities: DataFrame, budget: int = 2000) -> DataFrame:
    """Results with related entities: containers (half the score), imports of files, and types used (0.3 of it).

    ``results``: query_id, entity_id, score. Candidates are taken result by result in the order of
    score, of each result containers first, while they fit what is left of the budget; those that don't are
    passed over. Returns query_id, entity_id, score, source (null for the results themselves), reason.
    """
    e = entities.select(F.col("id").alias("entity_id"), "type", estimate_tokens(F.concat(F.coalesce("content", F.lit("")), F.coalesce("summary", F.lit("")))).alias("tokens"))
    own = results.select("query_id", "entity_id", "score")
    typed = own.join(e.select("entity_id", "type"), "entity_id")
    rel = F.upper("relationship")
    # repeated rows of an edge need not be dropped, as the first place of each candidate counts; so edges are only scanned
    g = edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    inward = g.where(rel == "CONTAINS").select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other"), "id", "weight")
    outward = g.where(rel.isin("IMPORTS", "USES", "IMPLEMENTS", "EXTENDS")).select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other"), "id", "weight", rel.alias("rel"))
    a = own.join(inward, "entity_id").select("query_id", "entity_id", "score", "other", "id", "weight", F.lit(0).alias("kind"))
    b = typed.join(outward, "entity_id").withColumn("kind", F.when(F.col("rel") == "IMPORTS", 1).otherwise(2)).where("kind = 2 or type = 'file'")
    found = a.unionByName(b.select(*a.columns)).join(own.select("query_id", F.col("entity_id").alias("other")), ["query_id", "other"], "left_anti")
    found = found.join(e.select(F.col("entity_id").alias("other"), F.col("type").alias("t"), "tokens"), "other").where("kind < 2 or t in ('type', 'interface', 'class')")
    # each candidate at the first place where it comes up
    place = F.struct((-F.col("score")).alias("s"), F.col("entity_id").alias("e"), "kind", (-F.col("weight")).alias("w"), "id")
    one = found.groupBy("query_id", "other", "tokens").agg(F.min(place).alias("place"))
    picked = greedy(one.select("query_id", "place", "tokens", "other"), "query_id", ["place", "other"], "tokens", budget, ["other", "place"])
    factor = F.when(F.col("place.kind") == 0, 0.5).otherwise(0.3)
    reason = F.when(F.col("place.kind") == 0, "parent").when(F.col("place.kind") == 1, "import").otherwise("type")
    more = picked.select("query_id", F.col("other").alias("entity_id"), (-F.col("place.s") * factor).alias("score"), F.lit("structural").alias("source"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    return own.select("*", none.alias("source"), none.alias("reason")).unionByName(more)


def format_entity(style: str = "markdown") -> Column:
    """Text of one entity (name, type, file_path, start_line, summary, content) in ``markdown``, ``xml`` or ``plain`` style."""
    from siftwell.functions.text import language, xml_escape

    e = F.lit("")
    body, summary, path = F.coalesce("content", e), F.coalesce("summary", e), F.coalesce("file_path", e)
    where = F.when(path != "", F.concat(path, F.when(F.col("start_line").isNotNull(), F.concat(F.lit(":"), F.col("start_line").cast("string"))).otherwise("")))
    if style == "xml":
        return F.concat(
            F.lit('<entity type="'), xml_escape(F.col("type")), F.lit('" name="'), xml_escape(F.col("name")), F.lit('"'),
            F.when(path != "", F.concat(F.lit(' file="'), xml_escape(path), F.lit('"'))).otherwise(""), F.lit(">\n"),
            F.when(summary != "", F.concat(F.lit("<summary>"), xml_escape(summary), F.lit("</summary>\n"))).otherwise(""),
            F.when(body != "", F.concat(F.lit("<content>"), xml_escape(body), F.lit("</content>\n"))).otherwise(""), F.lit("</entity>"),
        )
    if style == "plain":
        return F.concat_ws("\n", F.concat(F.col("type"), F.lit(": "), F.col("name")), where, F.when(summary != "", summary), F.when(body != "", body))
    code = F.concat(F.lit("```"), language(path), F.lit("\n"), body, F.lit("\n```"))
    text = F.when(category(F.col("type")) == "code", code).otherwise(body)
    return F.concat_ws("\n\n", F.concat(F.lit("### "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")")), where, F.when(summary != "", summary), F.when(body != "", text))


def assemble(results: DataFrame, entities: DataFrame, max_tokens: int = 4000, min_score: float = 0.1, style: str = "markdown") -> DataFrame:
    """query_id, context, tokens, sources, truncated: the texts of the best results that fit, grouped by category.

    Below ``min_score`` nothing is used, nor a file of which another entity is among the results. A
    category's heading is charged when it begins; the first text that does not fit ends everything.
    """
    x = results.where(F.col("score") >= min_score).join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    q = Window.partitionBy("query_id")
    shown = results.select("query_id", "entity_id").join(entities.select(F.col("id").alias("entity_id"), "type", "file_path"), "entity_id")
    shown = shown.where("type <> 'file' and file_path is not null").select("query_id", "file_path", F.lit("file").alias("type")).distinct()
    x = x.join(shown, ["query_id", "file_path", "type"], "left_anti")
    cat = category(F.col("type"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), cat)
    order = q.orderBy("cat_rank", F.col("score").desc(), "entity_id")
    head = F.concat(F.lit("## "), F.initcap("cat"))
    x = x.withColumn("cat", cat).withColumn("cat_rank", rank).withColumn("text", format_entity(style))
    first = F.row_number().over(Window.partitionBy("query_id", "cat").orderBy(F.col("score").desc(), "entity_id")) == 1
    x = x.withColumn("head", F.when(first, head)).withColumn("t", estimate_tokens(F.col("text"))).withColumn("cost", F.col("t") + F.when(first, estimate_tokens(head)).otherwise(0))
    x = x.withColumn("used", F.sum("cost").over(order)).withColumn("rn", F.row_number().over(order))
    fits = F.col("used") <= max_tokens - SOURCES_RESERVE
    x = x.withColumn("fits", fits)
    item = F.struct("rn", F.concat_ws("\n\n", "head", "text").alias("text"), "entity_id", "name", "cost")
    out = x.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("fits"), item))).alias("items"), F.max(~F.col("fits")).alias("truncated"))
    shown_names = F.transform(F.slice("items", 1, SOURCES_SHOWN), lambda i: F.concat(F.lit("- "), i["name"]))
    more = F.size("items") - SOURCES_SHOWN
    footer = F.concat(F.lit("Sources:\n"), F.array_join(F.when(more > 0, F.concat(shown_names, F.array(F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))))).otherwise(shown_names), "\n"))
    body = F.array_join(F.transform("items", lambda i: i["text"]), "\n\n")
    used = F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["cost"])
    return out.select(
        "query_id",
        F.when(F.size("items") > 0, F.concat_ws("\n\n", body, footer)).otherwise("").alias("context"),
        (used + F.when(F.size("items") > 0, estimate_tokens(footer)).otherwise(0)).alias("tokens"),
        F.transform("items", lambda i: i["entity_id"]).alias("sources"),
        "truncated",
    )


def summarize_names(df: DataFrame) -> DataFrame:
    """query_id, summary: names by category, three shown and how many more."""
    x = df.withColumn("cat", category(F.col("type"))).groupBy("query_id", "cat").agg(F.sort_array(F.collect_set("name")).alias("n"))
    more = F.when(F.size("n") > 3, F.concat(F.lit(" and "), (F.size("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat("cat", F.lit(": "), F.array_join(F.slice("n", 1, 3), ", "), more)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("cat"))
    return x.select("query_id", F.struct(rank.alias("r"), text.alias("t")).alias("x")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda i: i["t"]), "; ").alias("summary"))


def from_entities(entities: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Scores 1, 0.99, 0.98 ... that keep a given order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return entities.withColumn("score", 1 - 0.01 * (n - 1))
