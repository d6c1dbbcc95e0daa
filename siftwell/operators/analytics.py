"""Counts and statistics over entities, vectors, sessions, memory, feedback, suggestions and reflections.

Every result is one aggregation with partial sums before its shuffle. Ratios of nothing are as documented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of hot memory, cold items kept, and how full memory may be before a hint.
HOT_TOKENS, COLD_ITEMS, NEARLY_FULL = 4000, 1000, 0.9


def n_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def has_text(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def entity_stats(entities: DataFrame) -> DataFrame:
    """Per type: entities, those with a summary and with a hash, and files."""
    return entities.groupBy("type").agg(
        F.count("*").alias("n_entities"), n_if(has_text("summary")).alias("n_summary"), n_if(has_text("hash")).alias("n_hash"), F.countDistinct("file_path").alias("n_files")
    )


def embedding_coverage(entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per type: entities, and those that have a vector, each counted once however many chunks it has."""
    have = vectors.select(F.col("entity_id").alias("id"), F.lit(1).alias("_v")).distinct()
    per = entities.select("id", "type").distinct().join(have, "id", "left").groupBy("type")
    out = per.agg(F.count("*").alias("n_entities"), F.coalesce(F.sum("_v"), F.lit(0)).alias("n_embedded"))
    return out.withColumn("coverage", F.col("n_embedded") / F.col("n_entities") * 100)


def vectors_by_model(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model_id").agg(F.count("*").alias("n_vectors"), F.countDistinct("entity_id").alias("n_entities"), n_if(F.col("content_hash").isNull()).alias("n_without_hash"))


def orphan_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """Vectors of entities that are not there; a null entity id is none."""
    return vectors.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_anti").select(*vectors.columns)


def stale_vectors(vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """Vectors whose content_hash is null or not that of their entity (id, entity_hash)."""
    e = entities.select(F.col("id").alias("entity_id"), "entity_hash").distinct()
    return vectors.join(e, "entity_id").where(~F.col("content_hash").eqNullSafe(F.col("entity_hash"))).select(*vectors.columns)


def summary_coverage(entities: DataFrame) -> DataFrame:
    """Per type and in all (type null): entities, those with a summary, and their share in per cent."""
    x = entities.rollup("type").agg(F.grouping("type").alias("_g"), F.count("*").alias("n_entities"), n_if(has_text("summary")).alias("n_summary"))
    return x.where("_g = 1 or type is not null").select("type", "n_entities", "n_summary", (F.col("n_summary") / F.col("n_entities") * 100).alias("coverage"))


def health(entities: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: orphan edges, embedding coverage in per cent (0 for no entities) and its verdict."""
    from siftwell.operators.graph import orphan_edges

    bad = orphan_edges(edges.where("source_id is not null and target_id is not null"), entities).agg(F.count("*").alias("n_orphan_edges"))
    c = embedding_coverage(entities, vectors).agg(F.coalesce(F.sum("n_embedded") / F.sum("n_entities") * 100, F.lit(0.0)).alias("coverage"))
    v = F.when(F.col("coverage") >= 80, "ok").when(F.col("coverage") >= 50, "warn").otherwise("low")
    return bad.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k").select("n_orphan_edges", "coverage", v.alias("verdict"))


def session_stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: sessions by status and messages in them."""
    s = sessions.agg(
        F.count("*").alias("n_sessions"), *[n_if(F.col("status") == x).alias(f"n_{x}") for x in ("active", "archived", "summarized")]
    )
    m = messages.join(sessions.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi").agg(F.count("*").alias("n_messages"))
    return s.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")


def count_per_session(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, n_messages, 0 included."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    return sessions.select(F.col("id").alias("session_id")).distinct().join(n, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n_messages"))


def memory_status(items: DataFrame) -> DataFrame:
    """Per session: items and tokens of each tier, use of hot memory in per cent, and hints."""
    tiers = ("hot", "warm", "cold")
    sums = [a for t in tiers for a in (n_if(F.col("tier") == t).alias(f"{t}_items"), F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("token_count"))), F.lit(0)).alias(f"{t}_tokens"))]
    x = items.groupBy("session_id").agg(*sums)
    return x.withColumn("utilization", F.col("hot_tokens") / HOT_TOKENS * 100).withColumn("hint_spill", F.col("hot_tokens") > HOT_TOKENS * NEARLY_FULL).withColumn("hint_prune", F.col("cold_items") > COLD_ITEMS)


def spill_candidates(items: DataFrame, n: int = 4) -> DataFrame:
    """The hot items of each session that would go first: the least relevant, then the oldest; where to: warm from three accesses on."""
    w = Window.partitionBy("session_id").orderBy("relevance_score", "created_at", "id")
    x = items.where("tier = 'hot'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return x.withColumn("to_tier", F.when(F.col("access_count") >= 3, "warm").otherwise("cold"))


def prune_cold(items: DataFrame, keep: int = COLD_ITEMS) -> DataFrame:
    """Cold items of each session beyond the best ``keep`` by relevance + 0.1 accesses."""
    w = Window.partitionBy("session_id").orderBy((F.col("relevance_score") + 0.1 * F.col("access_count")).desc(), "id")
    return items.where("tier = 'cold'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") > keep).drop("rank")


def recall(items: DataFrame, queries: DataFrame, limit: int = 3, min_relevance: float = 0.0, promote_at: float = 0.85) -> DataFrame:
    """Best warm and cold items for each query (query_id, session_id, text) of their session, with what an access makes of them:
    one access more, the mean of old and new relevance, and the tier, hot from ``promote_at`` on."""
    from siftwell.functions.text import keyword_relevance

    x = items.where(F.col("tier").isin("warm", "cold")).join(queries.select("query_id", "session_id", "text"), "session_id")
    x = x.withColumn("relevance", keyword_relevance(F.col("content"), F.col("text"))).where(F.col("relevance") >= min_relevance)
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "id")
    hot = F.col("relevance") >= promote_at
    return (
        x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
        .withColumn("access_count", F.col("access_count") + 1)
        .withColumn("relevance_score", F.when(hot, 1.0).otherwise((F.col("relevance_score") + F.col("relevance")) / 2))
        .withColumn("tier", F.when(hot, "hot").otherwise(F.col("tier")))
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per entity: signals of each kind and the share of those used (0.5 for none)."""
    kinds = {"used": "used", "ignored": "ignored", "positive": "explicit_positive", "negative": "explicit_negative"}
    x = feedback.groupBy("entity_id").agg(F.count("*").alias("total"), *[n_if(F.col("signal") == s).alias(n) for n, s in kinds.items()])
    return x.withColumn("use_rate", F.when(F.col("total") > 0, F.col("used") / F.col("total")).otherwise(0.5))


def most_helpful(feedback: DataFrame, n: int) -> DataFrame:
    s = feedback_stats(feedback).withColumn("helpfulness", F.col("used") + 2 * F.col("positive") - 2 * F.col("negative"))
    return s.where("helpfulness > 0").orderBy(F.col("helpfulness").desc(), "entity_id").limit(n).select("entity_id", "helpfulness")


def most_ignored(feedback: DataFrame, n: int, least: int = 5) -> DataFrame:
    s = feedback_stats(feedback).where(F.col("total") >= least).withColumn("ignore_rate", F.col("ignored") / F.col("total"))
    return s.orderBy(F.col("ignore_rate").desc(), "entity_id").limit(n).select("entity_id", "ignore_rate", "total")


def used_in_response(returned: DataFrame, responses: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_id, signal: ``used`` if the response holds the entity's name or more than 30 % of its identifiers, else ``ignored``."""
    from siftwell.functions.text import identifiers, term_hits

    x = returned.join(responses, "query_id").join(entities.select(F.col("id").alias("entity_id"), "name", "content"), "entity_id", "left")
    low = F.lower("response")
    ids = identifiers(F.coalesce("content", F.lit("")))
    share = F.when(F.size(ids) > 0, term_hits(low, F.transform(ids, F.lower)) / F.size(ids)).otherwise(0.0)
    yes = F.coalesce(F.instr(low, F.lower("name")) > 0, F.lit(False)) | (share > 0.3)
    return x.select("query_id", "entity_id", F.when(yes, "used").otherwise("ignored").alias("signal"))


def suggestion_stats(suggestions: DataFrame) -> DataFrame:
    """Per session: suggestions by status, and the share used of those not pending (0 for none)."""
    x = suggestions.groupBy("session_id").agg(F.count("*").alias("total"), *[n_if(F.col("status") == s).alias(s) for s in ("pending", "shown", "used", "dismissed")])
    seen = F.col("shown") + F.col("used") + F.col("dismissed")
    return x.withColumn("use_rate", F.when(seen > 0, F.col("used") / seen).otherwise(0.0))


def reflection_summary(reflections: DataFrame, by: str | None = None) -> DataFrame:
    """Reflections, those that succeeded, and their share (per ``by``)."""
    x = reflections.groupBy(*([by] if by else [])).agg(F.count("*").alias("total"), n_if(F.col("outcome") == "success").alias("n_success"))
    return x.withColumn("success_rate", F.when(F.col("total") > 0, F.col("n_success") / F.col("total")).otherwise(0.0))


def common_phrases(reflections: DataFrame, by: str, outcome: str, column: str, latest: int = 20, most: int = 5) -> DataFrame:
    """The commonest phrases (trimmed, lower case) of the latest reflections of that outcome."""
    w = Window.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("id").desc())
    x = reflections.where(F.col("outcome") == outcome).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest)
    phrase = F.lower(F.regexp_replace("_p", r"^\s+|\s+$", ""))
    c = x.select(by, F.explode(column).alias("_p")).select(by, phrase.alias("phrase")).where("phrase <> ''").groupBy(by, "phrase").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "phrase")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def file_metrics(symbols: DataFrame) -> DataFrame:
    """Per file: functions, classes and the verdict on its complexity (low to 10, medium to 20 symbols)."""
    x = symbols.groupBy("file_path").agg(
        n_if(F.col("type").isin("function", "method")).alias("n_functions"), n_if(F.col("type") == "class").alias("n_classes"), F.count("*").alias("n_symbols")
    )
    return x.withColumn("complexity", F.when(F.col("n_symbols") <= 10, "low").when(F.col("n_symbols") <= 20, "medium").otherwise("high"))


def inspect(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, n_rows of several tables."""
    from functools import reduce

    parts = [
        d.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type")) for c, t in d.dtypes])).alias("x"))
        for n, d in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("table_name", "n_rows", "x.column_name", "x.column_type")


def impact_risk(reports: DataFrame) -> DataFrame:
    """Adds risk_score and risk_level to reports of n_deleted, n_modified, n_widely_used (entities used more than five times) and n_invalidated decisions."""
    s = 2 * F.col("n_deleted") + F.when(F.col("n_modified") > 10, F.floor(F.col("n_modified") / 5)).otherwise(0) + 3 * F.col("n_widely_used") + 2 * F.col("n_invalidated")
    return reports.withColumn("risk_score", s.cast("long")).withColumn("risk_level", F.when(F.col("risk_score") >= 10, "high").when(F.col("risk_score") >= 5, "medium").otherwise("low"))


def quick_risk(n_files: Column) -> Column:
    return F.when(n_files > 20, "high").when(n_files > 5, "medium").otherwise("low")


def impact(changes: DataFrame, entities: DataFrame, edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """report_id, counts and risk of change sets (report_id, path, status A/M/D).

    ``decisions``: id, entity_ids. A decision may be invalidated if an entity of a deleted file is among those it is about.
    """
    from siftwell.operators.graph import degrees

    files = changes.groupBy("report_id").agg(n_if(F.col("status") == "D").alias("n_deleted"), n_if(F.col("status") == "M").alias("n_modified"), n_if(F.col("status") == "A").alias("n_added"))
    hit = changes.select("report_id", F.col("path").alias("file_path"), "status").join(entities.select(F.col("id").alias("node"), "file_path"), "file_path")
    used = hit.join(degrees(edges).select("node", "n_in"), "node", "left").groupBy("report_id").agg(F.countDistinct("node").alias("n_entities"), F.countDistinct(F.when(F.col("n_in") > 5, F.col("node"))).alias("n_widely_used"))
    about = decisions.select(F.col("id").alias("decision"), F.explode("entity_ids").alias("node"))
    bad = hit.join(about, "node").groupBy("report_id").agg(F.countDistinct("decision").alias("n_decisions"), F.countDistinct(F.when(F.col("status") == "D", F.col("decision"))).alias("n_invalidated"))
    return impact_risk(files.join(used, "report_id", "left").join(bad, "report_id", "left").na.fill(0))
