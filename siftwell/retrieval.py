"""The whole way of a batch of queries: gate, parts, strategies, fusion, reranking, expansion, assembly, confidence.

Every stage is a table keyed by query_id, so that a batch is one plan. Models come as providers; without
one the semantic strategy is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell import providers
from siftwell.functions import queries as Q
from siftwell.operators import context, fusion, graph, resolve, search, vectors
from siftwell.runtime import materialize


def keyword_strategy(parsed: DataFrame, entities: DataFrame, limit: int, types: list[str] | None = None) -> DataFrame:
    """query_id, entity_id, score: the query itself at 1 / rank, its mentions at 1.5 (five hits each), its synonyms at 0.5 / rank.

    All texts of a batch are searched for at once, under keys of their own. One type restricts the query itself alone.
    """
    rows = F.concat(
        F.array(F.struct(F.col("normalized").alias("text"), F.lit("main").alias("kind"))),
        F.transform("mentions", lambda m: F.struct(m["text"].alias("text"), F.lit("mention").alias("kind"))),
        F.transform("expanded", lambda w: F.struct(w.alias("text"), F.lit("synonym").alias("kind"))),
    )
    q = parsed.select(F.col("query_id").alias("_q"), F.posexplode(rows).alias("_i", "r"))
    q = materialize(q.select("_q", F.concat_ws("\u0001", F.col("_q").cast("string"), F.col("_i").cast("string")).alias("query_id"), "r.text", "r.kind"))
    most = {"main": 2 * limit, "mention": 5, "synonym": max(1, limit // 2)}
    restricted = types if types and len(types) == 1 else None

    def hits(asked: DataFrame, pool: DataFrame, n: int) -> DataFrame:
        return search.tiered(pool, asked.select("query_id", "text"), n).join(asked.select("query_id", "_q", "kind"), "query_id")

    if restricted:
        found = hits(q.where("kind = 'main'"), entities.where(F.col("type").isin(restricted)), most["main"]).unionByName(hits(q.where("kind <> 'main'"), entities, max(5, most["synonym"])))
    else:
        found = hits(q, entities, max(most.values()))
    allowed = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("kind")]
    score = F.when(F.col("kind") == "mention", 1.5).when(F.col("kind") == "main", 1 / F.col("rank")).otherwise(0.5 / F.col("rank"))
    return found.where(F.col("rank") <= allowed).select(F.col("_q").alias("query_id"), F.col("doc").alias("entity_id"), score.alias("score"))


def semantic_strategy(parsed: DataFrame, store: DataFrame, make: Callable[[], providers.EmbeddingProvider], limit: int, model: str | None = None) -> DataFrame:
    """query_id, entity_id, score: nearest entities to the query, and at 0.8 to its keywords with synonyms."""
    words = F.array_join(F.concat("keywords", "expanded"), " ")

    def near(text, factor: float, most: int) -> DataFrame:
        q = providers.embed(parsed.select("query_id", text.alias("text")).where("text <> ''"), "text", make, query=True)
        hits = vectors.knn(store, q.where("embedding is not null").select("query_id", F.col("embedding").alias("vector")), most, model=model)
        return hits.select("query_id", "entity_id", (F.col("score") * factor).alias("score"))

    return near(F.col("normalized"), 1.0, 2 * limit).unionByName(near(F.when(F.size("expanded") > 0, words).otherwise(F.lit("")), 0.8, max(1, limit // 2)))


def graph_strategy(parsed: DataFrame, entities: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """query_id, entity_id, score: what is near the entities that a query mentions. An edge of weight w leads to
    1 / (1 / w + 1); the best edge that leads to an entity counts (a weight of 0 or null as 0.5)."""
    refs = parsed.select("query_id", F.explode("mentions.text").alias("text")).withColumn("ref_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), "text"))
    found = materialize(resolve.references(refs.select("ref_id", "text").distinct(), entities).join(refs.select("ref_id", "query_id").distinct(), "ref_id").select("query_id", F.col("entity_id").alias("start")).distinct())
    clean = graph.clean(edges)
    _, met = graph.neighbourhood(clean, found.select(F.col("start").alias("node")), depth)
    e = met.join(clean.select("id", "source_id", "target_id", "weight"), "id")
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.5)
    ends = e.select("start", F.explode(F.array("source_id", "target_id")).alias("entity_id"), (1 / (1 / w + 1)).alias("score")).where("entity_id <> start")
    return ends.groupBy("start", "entity_id").agg(F.max("score").alias("score")).join(found, "start").groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))


def search_all(
    queries: DataFrame,
    entities: DataFrame,
    edges: DataFrame | None = None,
    store: DataFrame | None = None,
    make: Callable[[], providers.EmbeddingProvider] | None = None,
    limit: int = 10,
    types: list[str] | None = None,
    min_score: float = 0.0,
    rerank: bool = True,
    parsed: DataFrame | None = None,
) -> DataFrame:
    """query_id, entity_id, score, source, rank of queries (query_id, text): the strategies fused by reciprocal rank, weighted for
    each query. ``min_score`` is on the scale of the fusion; reranking scales the best to 1. ``parsed``: the parsed queries,
    as a stored table, if they have been parsed before."""
    parsed = materialize(Q.parse(queries)) if parsed is None else parsed
    parts = [keyword_strategy(parsed, entities, limit, types).withColumn("source", F.lit("keyword"))]
    if store is not None and make is not None:
        parts.append(semantic_strategy(parsed, store, make, limit).withColumn("source", F.lit("semantic")))
    if edges is not None:
        parts.append(graph_strategy(parsed, entities, edges).withColumn("source", F.lit("graph")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    if types:
        hits = hits.join(entities.where(F.col("type").isin(types)).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(*parts[0].columns)
    fused = fusion.rrf(hits, parsed).where(F.col("score") >= min_score)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entity_id")
    best = materialize(fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit))
    return fusion.rerank(best.drop("rank"), queries, entities, limit) if rerank else best


def context_query(
    queries: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    store: DataFrame | None = None,
    make: Callable[[], providers.EmbeddingProvider] | None = None,
    max_tokens: int = 4000,
    limit: int = 10,
    min_score: float = 0.1,
    gate: bool = True,
    decompose: bool = False,
    expand: bool = True,
    style: str = "markdown",
) -> DataFrame:
    """query_id, retrieve, reason, context, tokens, sources, truncated, confidence of queries (query_id, text).

    A query that the gate turns away has an empty context. With ``decompose`` the independent parts of a
    query are searched for one by one, and an entity's best weighted score counts.
    """
    parsed = materialize(Q.parse(queries))
    verdict = parsed.select("query_id", "text", "gate.retrieve", "gate.reason")
    parsed = parsed.where(F.col("gate.retrieve") | F.lit(not gate))
    asked = parsed.select("query_id", "text")
    if decompose:
        key = F.concat_ws("\u0001", F.col("_q").cast("string"), F.col("part").cast("string"))
        parts = materialize(Q.decompose(asked).withColumnRenamed("query_id", "_q").withColumn("query_id", key))
        found = search_all(parts.select("query_id", "text"), entities, edges, store, make, limit).join(parts.select("query_id", "_q", "weight"), "query_id")
        hits = fusion.merge_best(found.select(F.col("_q").alias("query_id"), "entity_id", "score", "weight"))
    else:
        hits = search_all(asked, entities, edges, store, make, limit, parsed=parsed).select("query_id", "entity_id", "score")
    hits = materialize(hits)
    grown = context.expand(hits, edges, entities).select("query_id", "entity_id", "score") if expand else hits
    text = context.assemble(grown, entities, max_tokens, min_score, style)
    out = verdict.select("query_id", "retrieve", "reason").join(text, "query_id", "left").join(fusion.confidence(hits), "query_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "query_id", "retrieve", "reason", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("sources", none).alias("sources"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def hypothetical_vectors(parsed: DataFrame, make_text: Callable[[], providers.TextProvider], make: Callable[[], providers.EmbeddingProvider]) -> DataFrame:
    """query_id, vector of a hypothetical answer, for queries that are worth one and whose model answers."""
    on = providers.wants_hypothesis(F.col("normalized"), F.size("mentions"), F.col("intent"))
    prompt = F.concat(F.lit("Write a short passage that answers:\n"), "normalized")
    said = providers.complete(parsed.where(on).select("query_id", prompt.alias("prompt")), "prompt", make_text)
    return providers.embed(said.where("response is not null").select("query_id", "response"), "response", make).where("embedding is not null").select("query_id", F.col("embedding").alias("vector"))
