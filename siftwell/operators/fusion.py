"""Fusing, reranking and judging scored results: tables of query_id, entity_id, score, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import term_hits

#: The constant of reciprocal rank fusion, sources in the order in which they count as first, and their weights.
RRF_K = 60
SOURCES = ("keyword", "semantic", "graph", "structural", "hybrid")
WEIGHTS = {"keyword": 0.6, "semantic": 1.0, "graph": 0.8, "structural": 0.7, "hybrid": 1.0}
#: What a type does to a score.
TYPE_FACTORS = {"class": 1.3, "function": 1.2, "method": 1.2, "interface": 1.1, "type": 1.1, "document": 1.2, "section": 1.1, "file": 0.7, "module": 0.8}
#: Words that reranking passes over.
RERANK_STOP_WORDS = (
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of", "not", "no", "can", "had", "has",
    "have", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "this", "that", "these", "those", "how",
    "what", "why", "where", "when", "who", "from", "into", "about",
)


def _of(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[key], F.lit(default))


def rrf(results: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """query_id, entity_id, score, source: the sum of weight / (60 + rank in the source) over all of an entity's entries.

    Several entries of one source add up. ``weights`` (query_id, weights struct) takes the place of
    the fixed weights where it has the source. Ranks break ties by entity id.
    """
    order = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), F.col("entity_id"))
    w = _of(WEIGHTS, F.col("source"), 1.0)
    ranked = results.withColumn("_r", F.row_number().over(order))
    if weights is not None:
        ranked = ranked.join(weights.select("query_id", "weights"), "query_id", "left")
        own = F.when(F.col("source") == "keyword", F.col("weights.keyword")).when(F.col("source") == "semantic", F.col("weights.semantic")).when(F.col("source") == "graph", F.col("weights.graph"))
        w = F.coalesce(own, w)
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return ranked.groupBy("query_id", "entity_id").agg(F.sum(w / (RRF_K + F.col("_r"))).alias("score"), F.min_by("source", place).alias("source"))


def merge_best(results: DataFrame) -> DataFrame:
    """Results of weighted sub-queries (query_id, entity_id, score, weight): the best weighted score of each entity."""
    return results.groupBy("query_id", "entity_id").agg(F.max(F.col("score") * F.col("weight")).alias("score"))


def rerank(results: DataFrame, queries: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Results with their score multiplied by what name, summary, content, connections and type say, over the query's maximum.

    ``entities``: id, name, type, summary, content, metadata. Adds rank; ties go to the lesser id.
    """
    q = queries.select("query_id", F.lower("text").alias("_q"))
    stop = F.array(*map(F.lit, RERANK_STOP_WORDS))
    terms = F.filter(F.split("_q", r"\s+"), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))
    e = entities.select(F.col("id").alias("entity_id"), "name", "type", "summary", "content", "metadata")
    x = results.join(q, "query_id").join(e, "entity_id").withColumn("_t", terms)

    def share(c: str, boost: float) -> Column:
        return F.when(F.size("_t") > 0, 1 + term_hits(F.col(c), F.col("_t")) / F.size("_t") * boost).otherwise(1.0)

    meta = F.col("metadata")
    priority = F.coalesce(meta["priority"], F.lit("normal"))
    instruction = F.when(priority == "high", 2.0).when(priority == "low", 0.5).otherwise(1.0) * F.when(meta["active"] == "false", 0.001).otherwise(1.0)
    factor = (
        F.when(F.lower("name") == F.col("_q"), 3.0).otherwise(1.0)
        * share("name", 1.5)
        * share("summary", 0.5)
        * F.when((F.length("content") > 0) & (F.length("content") < 50), 0.5).otherwise(1.0)
        * F.when(F.try_to_number(meta["connectionCount"], F.lit("999999999")) > 5, 1.15).otherwise(1.0)
        * _of(TYPE_FACTORS, F.col("type"), 1.0)
        * F.when(F.col("type") == "instruction", instruction).otherwise(1.0)
    )
    by = Window.partitionBy("query_id")
    scored = x.withColumn("_s", F.col("score") * factor).withColumn("score", F.col("_s") / F.greatest(F.max("_s").over(by), F.lit(0.001)))
    out = scored.withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), F.col("entity_id"))))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    return out.select("query_id", "entity_id", "score", *(["source"] if "source" in results.columns else []), "rank")


def blend_model_scores(results: DataFrame, top: int) -> DataFrame:
    """0.7 model_score / its maximum + 0.3 score for the first ``top`` results; results without a model score keep theirs."""
    by = Window.partitionBy("query_id")
    most = F.max(F.when(F.col("rank") <= top, F.col("model_score"))).over(by)
    return results.withColumn("score", F.when((F.col("rank") <= top) & F.col("model_score").isNotNull() & (most > 0), 0.7 * F.col("model_score") / most + 0.3 * F.col("score")).otherwise(F.col("score")))


def adjust_by_feedback(results: DataFrame, stats: DataFrame) -> DataFrame:
    """Scores times what feedback says of the entity, from 0.3 to 1.7, once there are five signals.

    ``stats``: entity_id, total, use_rate, positive, negative.
    """
    f = F.least(F.lit(1.7), F.greatest(F.lit(0.3), 0.5 + F.col("use_rate") + 0.1 * F.least("positive", F.lit(3)) - 0.15 * F.least("negative", F.lit(3))))
    x = results.join(stats.select("entity_id", "total", "use_rate", "positive", "negative"), "entity_id", "left")
    return x.withColumn("multiplier", F.when(F.col("total") >= 5, f).otherwise(1.0)).select(
        *[c for c in results.columns if c != "score"], (F.col("score") * F.col("multiplier")).alias("score"), "multiplier"
    )


def confidence(results: DataFrame, top: int = 5) -> DataFrame:
    """query_id, confidence: the mean of the best scores, each weighing 0.7 of the one before; at most 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("entity_id"))
    w = F.pow(F.lit(0.7), F.col("_r") - 1)
    x = results.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return x.groupBy("query_id").agg(F.least(F.lit(1.0), F.sum(w * F.greatest("score", F.lit(0.0))) / F.sum(w)).alias("confidence"))
