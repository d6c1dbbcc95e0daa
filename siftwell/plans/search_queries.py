"""Queries on keyword and vector search, fusion, ranking and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import retrieval
from siftwell.functions import queries as Q
from siftwell.functions import text as T
from siftwell.operators import context as X
from siftwell.operators import entities as E
from siftwell.operators import fusion, search, vectors
from siftwell.runtime import materialize, read

#: A batch of questions on the tables.
BATCH = (
    (1, "register client gateway"),
    (2, "DurablePlanner"),
    (3, "how does readImporter work"),
    (4, "stale cache in src/journal"),
    (5, "explain the partition ledger"),
    (6, "zzqx"),
)
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in BATCH)
_BATCH = f"batch(query_id, text) AS (VALUES {_VALUES})"


def batch(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS batch(query_id, text)")


def ents(spark: SparkSession, d: str) -> DataFrame:
    """Entities, one row per id: the latest."""
    return E.latest(read(spark, d, "entities"))


_ENT = "ent AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"


def r6(c):
    return F.round(c, 6)


def keyword_bm25_topk(spark, d):
    docs = read(spark, d, "documents")
    hits = search.bm25_scan(docs, "doc_id", ["text"], batch(spark), prefix=False)
    # rounded before the cut, so that scores that differ by rounding alone are ties
    return search.top(hits.withColumn("score", r6("score")), 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_TERMS = f"""words AS (SELECT query_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM batch),
camel AS (SELECT query_id, w, string_split_regex(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+') AS c FROM words),
parts AS (SELECT query_id, unnest(list_concat([w, lower(w)], c)) AS p FROM camel),
terms AS (SELECT DISTINCT query_id, t AS qterm FROM (SELECT query_id, unnest({_TOK.format("p")}) AS t FROM parts) WHERE length(t) > 1)"""
_BM25 = f"""
WITH {_BATCH}, {_TERMS},
tok AS (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS t FROM documents),
corpus AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
post AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM post WHERE term IN (SELECT qterm FROM terms) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score
  FROM terms JOIN tf ON qterm = term JOIN df USING (term) CROSS JOIN corpus GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored
QUALIFY rank <= 10"""


def tiered_search_scored(spark, d):
    return search.tiered(materialize(ents(spark, d)), batch(spark), 20).select("query_id", F.col("doc").alias("entity_id"), "tier", r6("score").alias("score"))


def exact_name_search(spark, d):
    return search.exact_name(ents(spark, d), batch(spark)).select("query_id", F.col("doc").alias("entity_id"))


def like_substring_search(spark, d):
    e = ents(spark, d)
    return search.substrings(e, "id", ["name", "content", "summary"], {1: "gateway", 2: "Planner", 4: "src/journal"}).select("query_id", F.col("doc").alias("entity_id"))


def term_and_search(spark, d):
    return search.all_terms(read(spark, d, "messages"), "id", "content", "cache_worker").distinct().select(F.col("doc").alias("message_id"))


def message_search_stemmed(spark, d):
    """Messages that hold every stemmed term of the query, best first."""
    m = read(spark, d, "messages").dropDuplicates(["id"])
    index = search.stemmed(search.postings(m, "id", "content"), "term")
    q = spark.createDataFrame([(1, "caching workers"), (2, "validated partition")], "query_id int, text string")
    stems = search.stemmed(search.query_terms(q), "qterm")
    hits = search.matches(index, stems, prefix=False)
    n = stems.groupBy("query_id").agg(F.count("*").alias("_all"))
    return hits.groupBy("query_id", "doc").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("tf")).join(n, "query_id").where("n_terms = _all").select("query_id", F.col("doc").alias("message_id"), "tf")


def _embeddings(spark, d):
    return read(spark, d, "embeddings")


def _questions(spark, d):
    """The query set: every vector whose id is divisible by 50."""
    e = _embeddings(spark, d)
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def knn_topk(spark, d):
    e = _embeddings(spark, d).select(F.col("vec_id").alias("entity_id"), "embedding")
    return vectors.knn(e, _questions(spark, d), 10).select("query_id", "entity_id", r6("score").alias("score"), "rank")


def knn_best_chunk_dedup(spark, d):
    e = _embeddings(spark, d).select(F.floor(F.col("vec_id") / 4).alias("entity_id"), "embedding")
    return vectors.knn(e, _questions(spark, d), 10).select("query_id", "entity_id", r6("score").alias("score"), "rank")


def knn_type_filter(spark, d):
    e = _embeddings(spark, d)
    allowed = e.where("label in (1, 2)").select(F.col("vec_id").alias("entity_id"))
    x = e.select(F.col("vec_id").alias("entity_id"), "embedding")
    return vectors.knn(x, _questions(spark, d), 10, threshold=0.05, allowed=allowed).select("query_id", "entity_id", r6("score").alias("score"), "rank")


def _knn_sql(entity: str, where: str = "true", threshold: float = -1.0) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, {entity} AS entity_id, max(coalesce(list_cosine_similarity(v, embedding::DOUBLE[]), 0)) AS score FROM q, embeddings WHERE {where} GROUP BY 1, 2)
SELECT query_id, entity_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id))::INT AS rank
FROM s WHERE score >= {threshold} QUALIFY rank <= 10"""


def _results(spark, d):
    """Scored results of three sources: words found in the name, in the content, and entities of the same file."""
    e = ents(spark, d)
    pats = {1: "gateway", 2: "planner", 3: "importer", 4: "journal", 5: "ledger"}
    kw = search.substrings(e, "id", ["name"], pats).select("query_id", F.col("doc").alias("entity_id"), F.lit("keyword").alias("source"))
    se = search.substrings(e, "id", ["content"], pats).select("query_id", F.col("doc").alias("entity_id"), F.lit("semantic").alias("source"))
    gr = search.substrings(e, "id", ["file_path"], pats).select("query_id", F.col("doc").alias("entity_id"), F.lit("graph").alias("source"))
    scored = kw.unionByName(se).unionByName(gr).join(e.select(F.col("id").alias("entity_id"), F.length("name").alias("n")), "entity_id")
    return scored.select("query_id", "entity_id", "source", (1 / F.col("n")).alias("score"))


_PATS = "pats(query_id, p) AS (VALUES (1, 'gateway'), (2, 'planner'), (3, 'importer'), (4, 'journal'), (5, 'ledger'))"
_RESULTS = f"""{_PATS}, res AS (
  SELECT query_id, id AS entity_id, 'keyword' AS source, 1.0 / length(name) AS score FROM ent, pats WHERE contains(lower(name), p)
  UNION ALL SELECT query_id, id, 'semantic', 1.0 / length(name) FROM ent, pats WHERE contains(lower(content), p)
  UNION ALL SELECT query_id, id, 'graph', 1.0 / length(name) FROM ent, pats WHERE contains(lower(file_path), p)),
w(source, w, o) AS (VALUES ('keyword', 0.6, 1), ('semantic', 1.0, 2), ('graph', 0.8, 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, entity_id) AS r FROM res JOIN w USING (source)),
fused AS (SELECT query_id, entity_id, sum(w / (60 + r)) AS score, arg_min(source, o) AS source FROM ranked GROUP BY 1, 2)"""


def rrf_fusion(spark, d):
    return fusion.rrf(_results(spark, d)).select("query_id", "entity_id", r6("score").alias("score"), "source")


def heuristic_rerank(spark, d):
    fused = materialize(fusion.rrf(_results(spark, d)))
    return fusion.rerank(fused, batch(spark), ents(spark, d)).select("query_id", "entity_id", r6("score").alias("score"))


_FACTOR = """(CASE WHEN lower(name) = lower(text) THEN 3.0 ELSE 1 END)
  * (CASE WHEN len(t) > 0 THEN 1 + len(list_filter(t, lambda x: contains(lower(name), x))) / len(t) * 1.5 ELSE 1 END)
  * (CASE WHEN len(t) > 0 THEN 1 + len(list_filter(t, lambda x: contains(lower(coalesce(summary, '')), x))) / len(t) * 0.5 ELSE 1 END)
  * (CASE WHEN length(content) BETWEEN 1 AND 49 THEN 0.5 ELSE 1 END)
  * (CASE WHEN TRY_CAST(metadata['connectionCount'] AS DOUBLE) > 5 THEN 1.15 ELSE 1 END)
  * coalesce(MAP {'class': 1.3, 'function': 1.2, 'method': 1.2, 'interface': 1.1, 'type': 1.1, 'document': 1.2, 'section': 1.1, 'file': 0.7, 'module': 0.8}[type], 1)
  * (CASE WHEN type = 'instruction' THEN (CASE coalesce(metadata['priority'], 'normal') WHEN 'high' THEN 2.0 WHEN 'low' THEN 0.5 ELSE 1 END) * (CASE WHEN metadata['active'] = 'false' THEN 0.001 ELSE 1 END) ELSE 1 END)"""
_STOP = ", ".join(f"'{w}'" for w in fusion.RERANK_STOP_WORDS)
_RERANK = f"""WITH {_BATCH}, {_ENT}, {_RESULTS},
terms AS (SELECT *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS t FROM batch),
m AS (SELECT query_id, entity_id, score * {_FACTOR} AS s FROM fused JOIN terms USING (query_id) JOIN ent ON id = entity_id),
best AS (SELECT query_id, entity_id, s / greatest(max(s) OVER (PARTITION BY query_id), 0.001) AS score FROM m)"""


def confidence_topk_decay(spark, d):
    return fusion.confidence(fusion.rerank(fusion.rrf(_results(spark, d)), batch(spark), ents(spark, d))).select("query_id", r6("confidence").alias("confidence"))


def token_budget_prefix(spark, d):
    docs = read(spark, d, "documents").where("text is not null and source is not null").withColumn("tokens", T.estimate_tokens(F.col("text")))
    return X.prefix(docs.select("source", "doc_id", "tokens"), "source", [F.col("doc_id")], "tokens", 4000).select("source", "doc_id", "tokens", F.col("used").cast("long").alias("used"))


def budget_greedy_skip(spark, d):
    """Each file's entities in the order of their lines, as long as they fit 400 tokens."""
    e = ents(spark, d).where("file_path is not null").select("file_path", F.coalesce("start_line", F.lit(0)).alias("start_line"), "id", T.estimate_tokens(F.col("content")).alias("tokens"))
    return X.greedy(e, "file_path", ["start_line", "id"], "tokens", 400, ["id"]).select("file_path", F.col("pos").alias("pos"), "id", "tokens")


_GREEDY = f"""
WITH RECURSIVE {_ENT},
e AS (SELECT file_path, id, ceil(length(coalesce(content, '')) / 4.0)::BIGINT AS t, row_number() OVER (PARTITION BY file_path ORDER BY coalesce(start_line, 0), id) AS rn FROM ent WHERE file_path IS NOT NULL),
f(file_path, rn, id, t, used, pos, took) AS (
  SELECT file_path, rn, id, t, CASE WHEN t <= 400 THEN t ELSE 0 END, CASE WHEN t <= 400 THEN 0 ELSE -1 END, t <= 400 FROM e WHERE rn = 1
  UNION ALL SELECT e.file_path, e.rn, e.id, e.t, CASE WHEN used + e.t <= 400 THEN used + e.t ELSE used END, CASE WHEN used + e.t <= 400 THEN pos + 1 ELSE pos END, used + e.t <= 400
  FROM f JOIN e ON e.file_path = f.file_path AND e.rn = f.rn + 1)
SELECT file_path, pos::INT AS pos, id, t AS tokens FROM f WHERE took"""


def context_assemble(spark, d):
    """The whole way: keyword tiers, fusion, reranking, expansion and assembly for the batch."""
    e = materialize(ents(spark, d))
    hits = search.tiered(e, batch(spark), 20).select("query_id", F.col("doc").alias("entity_id"), "score", F.lit("keyword").alias("source"))
    ranked = materialize(fusion.rerank(fusion.rrf(materialize(hits)), batch(spark), e, limit=10))
    grown = X.expand(ranked, read(spark, d, "relationships"), e)
    return X.assemble(grown.select("query_id", "entity_id", "score"), e).withColumn("sources", F.array_join("sources", ","))


def context_query(spark, d):
    """The flagship: gate, parse, keyword and graph strategies, fusion, reranking, expansion, assembly, confidence."""
    got = retrieval.context_query(batch(spark), materialize(ents(spark, d)), read(spark, d, "relationships"))
    return got.select("query_id", "retrieve", "reason", "context", "tokens", F.array_join("sources", ",").alias("sources"), "truncated", r6("confidence").alias("confidence"))


def context_expansion(spark, d):
    e = ents(spark, d)
    top = search.exact_name(e, spark.createDataFrame([(i, n) for i, n in enumerate(("DurablePlanner", "readImporter", "importHandle", "FinalOutbox"))], "query_id int, text string"))
    return X.expand(top.select("query_id", F.col("doc").alias("entity_id"), F.lit(1.0).alias("score")), read(spark, d, "relationships"), e)


def query_parse(spark, d):
    p = Q.parse(batch(spark))
    return p.select("query_id", "normalized", F.array_join("keywords", " ").alias("keywords"), "intent", "confidence", F.col("gate.retrieve").alias("retrieve"), r6("weights.keyword").alias("w_keyword"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_bm25_topk, tiered_search_scored, exact_name_search, like_substring_search, term_and_search, message_search_stemmed, knn_topk,
        knn_best_chunk_dedup, knn_type_filter, rrf_fusion,
        heuristic_rerank, confidence_topk_decay, token_budget_prefix, budget_greedy_skip,
        context_assemble, context_query, context_expansion, query_parse,
    )
}
_TIERS = f"""
WITH {_BATCH}, {_ENT}, {_TERMS},
tok AS (SELECT id, {_TOK.format("concat_ws(' ', name, content, summary)")} AS t FROM ent),
corpus AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
post AS (SELECT id, len(t) AS n, unnest(t) AS term FROM tok),
tf AS (SELECT qterm, id, any_value(n) AS n, count(*) AS tf FROM post JOIN (SELECT DISTINCT qterm FROM terms) ON starts_with(term, qterm) GROUP BY 1, 2),
df AS (SELECT qterm, count(*) AS df FROM tf GROUP BY 1),
fts AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 9) AS b
  FROM terms JOIN tf USING (qterm) JOIN df USING (qterm) CROSS JOIN corpus GROUP BY 1, 2),
hits AS (
  SELECT query_id, id, 1 AS tier, 1.0::DOUBLE AS score, 0.0::DOUBLE AS b FROM batch JOIN ent ON lower(name) = lower(trim(text))
  UNION ALL SELECT query_id, id, 2, 0.95, 0 FROM batch JOIN ent ON ends_with(lower(qualified_name), '::' || lower(trim(text)))
  UNION ALL SELECT query_id, id, 3, b / (1 + b), b FROM fts),
every AS (FROM hits UNION ALL SELECT query_id, id, 4, 0.3, 0 FROM batch, ent
  WHERE query_id NOT IN (SELECT query_id FROM hits) AND (contains(lower(name), lower(trim(text))) OR contains(lower(content), lower(trim(text))) OR contains(lower(summary), lower(trim(text))))),
one AS (SELECT query_id, id, min(tier) AS tier, arg_min(score, tier) AS score, arg_min(b, tier) AS b FROM every GROUP BY 1, 2)
SELECT query_id, id AS entity_id, tier::INT AS tier, round(score, 6) AS score FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, b DESC, id) <= 20"""
_WORDS = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
_INTENT = " ".join(f"WHEN regexp_matches(lower(trim(text)), '{p}') THEN {{'i': '{i}', 'c': {w}::DOUBLE}}" for p, i, w in sorted(Q.INTENTS, key=lambda x: -x[2]))
#: The queries of the batch name entities in Pascal case only.
_PARSE = f"""
WITH {_BATCH}, n AS (SELECT query_id, text, trim(regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '[?!.]+$', '')) AS s, len(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')) AS m,
  CASE {_INTENT} ELSE {{'i': 'general', 'c': 0.3::DOUBLE}} END AS x FROM batch),
k AS (SELECT *, list_filter(string_split_regex(lower(s), '[\\s\\-_.,;:!?''"()\\[\\]{{}}]+'), lambda t: length(t) >= 2 AND t NOT IN ({_WORDS}) AND NOT regexp_matches(t, '^[0-9]+$')) AS k FROM n)
SELECT query_id, s AS normalized, array_to_string(k, ' ') AS keywords, x.i AS intent, x.c AS confidence, true AS retrieve,
  round(0.6 * CASE WHEN m > 0 THEN 1.5 ELSE 1 END * CASE WHEN m > 0 AND len(k) <= 2 THEN 2.0 ELSE 1 END * CASE WHEN regexp_matches(s, '(?i)^(how|what|why|where|when|which)') THEN 0.7 ELSE 1 END::DOUBLE, 6) AS w_keyword FROM k"""


def _expand_sql(own: str) -> str:
    """CTEs that end in ``grown`` (query_id, entity_id, score, source, reason), from CTEs that end in ``own`` (query_id, entity_id, score) and ``ent``."""
    return f"""{own}, size AS (SELECT id, type, ceil(length(coalesce(content, '') || coalesce(summary, '')) / 4.0)::BIGINT AS t FROM ent),
rel AS (SELECT id, source_id, target_id, upper(relationship) AS r, coalesce(weight, 1.0) AS w FROM relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
near AS (SELECT query_id, entity_id, score, source_id AS other, rel.id, w, 0 AS kind FROM own JOIN rel ON target_id = entity_id AND r = 'CONTAINS'
  UNION ALL SELECT query_id, entity_id, score, target_id, rel.id, w, CASE WHEN r = 'IMPORTS' THEN 1 ELSE 2 END FROM own JOIN rel ON source_id = entity_id AND r IN ('IMPORTS', 'USES', 'IMPLEMENTS', 'EXTENDS') JOIN size z ON z.id = entity_id WHERE r <> 'IMPORTS' OR type = 'file'),
cand AS (SELECT query_id, other, t, min({{'s': -score, 'e': entity_id, 'k': kind, 'w': -w, 'i': near.id}}) AS p FROM near JOIN size z ON z.id = other
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = near.query_id AND o.entity_id = other) AND (kind < 2 OR type IN ('type', 'interface', 'class')) GROUP BY 1, 2, 3),
line AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, other) AS rn FROM cand),
walk(query_id, rn, other, p, used, took) AS (SELECT query_id, rn, other, p, CASE WHEN t <= 2000 THEN t ELSE 0 END, t <= 2000 FROM line WHERE rn = 1
  UNION ALL SELECT l.query_id, l.rn, l.other, l.p, CASE WHEN used + l.t <= 2000 THEN used + l.t ELSE used END, used + l.t <= 2000 FROM walk w JOIN line l ON l.query_id = w.query_id AND l.rn = w.rn + 1),
grown AS (SELECT query_id, entity_id, score, NULL::VARCHAR AS source, NULL::VARCHAR AS reason FROM own
  UNION ALL SELECT query_id, other, -p.s * CASE WHEN p.k = 0 THEN 0.5 ELSE 0.3 END::DOUBLE, 'structural', CASE p.k WHEN 0 THEN 'parent' WHEN 1 THEN 'import' ELSE 'type' END FROM walk WHERE took)"""


_NAMED = "own AS (SELECT DISTINCT q AS query_id, id AS entity_id, 1.0::DOUBLE AS score FROM ent JOIN (VALUES (0, 'DurablePlanner'), (1, 'readImporter'), (2, 'importHandle'), (3, 'FinalOutbox')) v(q, n) ON lower(name) = lower(n))"
SQL = {
    "query_parse": _PARSE,
    "keyword_bm25_topk": _BM25,
    "tiered_search_scored": _TIERS,
    "exact_name_search": f"WITH {_BATCH}, {_ENT} SELECT query_id, id AS entity_id FROM ent JOIN batch ON lower(name) = lower(trim(text))",
    "like_substring_search": f"""WITH {_ENT}, p(query_id, p) AS (VALUES (1, 'gateway'), (2, 'planner'), (4, 'src/journal'))
SELECT query_id, id AS entity_id FROM ent, p WHERE contains(lower(name), p) OR contains(lower(content), p) OR contains(lower(summary), p)""",
    "term_and_search": "SELECT DISTINCT id AS message_id FROM messages WHERE contains(lower(content), 'cache') AND contains(lower(content), 'worker')",
    "knn_topk": _knn_sql("vec_id"),
    "knn_best_chunk_dedup": _knn_sql("vec_id // 4"),
    "knn_type_filter": _knn_sql("vec_id", "label IN (1, 2)", 0.05),
    "rrf_fusion": f"WITH {_ENT}, {_RESULTS} SELECT query_id, entity_id, round(score, 6) AS score, source FROM fused",
    "heuristic_rerank": f"{_RERANK} SELECT query_id, entity_id, round(score, 6) AS score FROM best",
    "confidence_topk_decay": f"""{_RERANK}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rn FROM best)
SELECT query_id, round(least(1.0, sum(pow(0.7, rn - 1) * greatest(score, 0)) / sum(pow(0.7, rn - 1))), 6) AS confidence FROM r WHERE rn <= 5 GROUP BY 1""",
    "token_budget_prefix": """SELECT source, doc_id, ceil(length(text) / 4.0)::INT AS tokens, (sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS used
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL QUALIFY used <= 4000""",
    "budget_greedy_skip": _GREEDY,
}
SQL["context_expansion"] = f"WITH RECURSIVE {_ENT}, {_expand_sql(_NAMED)} SELECT query_id, entity_id, score, source, reason FROM grown"
_CATS = "CASE " + " ".join(f"WHEN type IN ({', '.join(repr(t) for t in ts)}) THEN '{c}'" for c, ts in X.CATEGORIES.items()) + " ELSE 'other' END"
_LANG = f"coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in T.LANGUAGES.items())}}}[lower(regexp_extract(coalesce(file_path, ''), '[.]([A-Za-z0-9]+)$', 1))], '')"
_TOP = f"""tiers AS ({_TIERS.strip()}), fused AS (SELECT query_id, entity_id, 0.6 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id)) AS score FROM tiers),
terms AS (SELECT *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS t FROM batch),
m AS (SELECT query_id, entity_id, score * {_FACTOR} AS s FROM fused JOIN terms USING (query_id) JOIN ent ON id = entity_id),
best AS (SELECT query_id, entity_id, s / greatest(max(s) OVER (PARTITION BY query_id), 0.001) AS score FROM m),
own AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= 10)"""
#: CTEs from ``grown`` and ``ent`` to ``assembled``: query_id, context, tokens, sources, truncated.
_ASSEMBLED = f"""shown AS (SELECT DISTINCT query_id, file_path FROM grown JOIN ent ON id = entity_id WHERE type <> 'file' AND file_path IS NOT NULL),
x AS (SELECT query_id, entity_id, score, name, {_CATS} AS cat, concat_ws(chr(10) || chr(10), '### ' || name || ' (' || type || ')', CASE WHEN file_path <> '' THEN file_path || coalesce(':' || start_line, '') END,
  CASE WHEN summary <> '' THEN summary END, CASE WHEN content <> '' THEN CASE WHEN {_CATS} = 'code' THEN '```' || {_LANG} || chr(10) || content || chr(10) || '```' ELSE content END END) AS body
  FROM grown g JOIN ent ON id = entity_id WHERE score >= 0.1 AND NOT (type = 'file' AND EXISTS (SELECT 1 FROM shown s WHERE s.query_id = g.query_id AND s.file_path = ent.file_path))),
h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, cat ORDER BY score DESC, entity_id) = 1 THEN '## ' || upper(cat[1]) || cat[2:] END AS head, list_position(['code', 'documentation', 'conversation', 'other'], cat) AS cr FROM x),
c AS (SELECT *, ceil(length(body) / 4.0) + coalesce(ceil(length(head) / 4.0), 0) AS cost FROM h),
u AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY query_id ORDER BY cr, score DESC, entity_id)),
g AS (SELECT query_id, coalesce(list({{'t': concat_ws(chr(10) || chr(10), head, body), 'e': entity_id, 'n': name, 'c': cost}} ORDER BY rn) FILTER (used <= 3800), []) AS items, bool_or(used > 3800) AS truncated FROM u GROUP BY 1),
f AS (SELECT *, 'Sources:' || chr(10) || array_to_string(list_concat(list_transform(items[:10], lambda i: '- ' || i.n), CASE WHEN len(items) > 10 THEN ['... and ' || (len(items) - 10) || ' more'] ELSE [] END), chr(10)) AS footer FROM g),
assembled AS (SELECT query_id, CASE WHEN len(items) > 0 THEN array_to_string(list_transform(items, lambda i: i.t), chr(10) || chr(10)) || chr(10) || chr(10) || footer ELSE '' END AS context,
  (coalesce(list_sum(list_transform(items, lambda i: i.c)), 0) + CASE WHEN len(items) > 0 THEN ceil(length(footer) / 4.0) ELSE 0 END)::BIGINT AS tokens, array_to_string(list_transform(items, lambda i: i.e), ',') AS sources, truncated FROM f)"""
SQL["context_assemble"] = f"WITH RECURSIVE {_BATCH}, {_ENT}, {_expand_sql(_TOP)}, {_ASSEMBLED} SELECT query_id, context, tokens, sources, truncated FROM assembled"
_SYNONYMS = ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(Q.synonym_pairs()))
_WAY = f"""parsed AS ({_PARSE.strip()}), syn(w, s, o) AS (VALUES {_SYNONYMS}), kws AS (SELECT query_id, unnest(string_split(keywords, ' ')) AS w FROM parsed),
named AS (SELECT query_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')) AS t FROM batch),
asked AS (SELECT query_id || '|0' AS query_id, query_id AS q, normalized AS text, 'main' AS kind FROM parsed UNION ALL SELECT query_id || '|1' || t, query_id, t, 'mention' FROM named
  UNION ALL SELECT DISTINCT query_id || '|2' || s, query_id, s, 'synonym' FROM kws JOIN syn USING (w) WHERE NOT EXISTS (SELECT 1 FROM kws k WHERE k.query_id = kws.query_id AND k.w = syn.s)),
found AS ({_TIERS.strip().replace(f"WITH {_BATCH}", "WITH batch AS (SELECT query_id, text FROM asked)").replace("SELECT query_id, id AS entity_id, tier::INT AS tier, round(score, 6) AS score FROM one QUALIFY", "SELECT query_id, id AS entity_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, b DESC, id) AS rank FROM one QUALIFY")}),
kw AS (SELECT q AS query_id, entity_id, CASE kind WHEN 'mention' THEN 1.5 WHEN 'main' THEN 1 / rank ELSE 0.5 / rank END::DOUBLE AS score FROM found JOIN asked USING (query_id) WHERE rank <= CASE kind WHEN 'main' THEN 20 ELSE 5 END),
hit AS (SELECT query_id, id, 1 AS tier FROM named JOIN ent ON qualified_name = t UNION ALL SELECT query_id, id, 2 FROM named JOIN ent ON file_path = t AND type = 'file'
  UNION ALL SELECT query_id, id, CASE WHEN type IN ('class', 'interface', 'type') THEN 3 WHEN type IN ('function', 'method') THEN 4 ELSE 5 END FROM named JOIN ent ON name = t),
seed AS (SELECT query_id, arg_min(id, (tier, id)) AS a FROM hit GROUP BY 1), two AS (SELECT DISTINCT ON (id) id, source_id AS a, target_id AS b, coalesce(weight, 1.0) AS w FROM relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
one_hop AS (SELECT query_id, s.a AS start, s.a AS node FROM seed s UNION SELECT query_id, s.a, CASE WHEN two.a = s.a THEN two.b ELSE two.a END FROM seed s JOIN two ON two.a = s.a OR two.b = s.a),
edge_met AS (SELECT DISTINCT query_id, start, two.* FROM one_hop JOIN two ON two.a = node OR two.b = node),
gr AS (SELECT query_id, e AS entity_id, max(1 / (1 / CASE WHEN w > 0 THEN w ELSE 0.5 END + 1)) AS score FROM (SELECT query_id, start, a AS e, w FROM edge_met UNION ALL SELECT query_id, start, b, w FROM edge_met) WHERE e <> start GROUP BY 1, 2),
src AS (SELECT *, 'keyword' AS source FROM kw UNION ALL SELECT *, 'graph' FROM gr),
rk AS (SELECT src.*, row_number() OVER (PARTITION BY src.query_id, source ORDER BY score DESC, entity_id) AS r, CASE source WHEN 'keyword' THEN w_keyword ELSE 0.8 * CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.query_id = src.query_id) THEN 1.3 ELSE 1 END END::DOUBLE AS w FROM src JOIN parsed USING (query_id)),
rrf AS (SELECT query_id, entity_id, sum(w / (60 + r)) AS score FROM rk GROUP BY 1, 2), fused AS (SELECT * FROM rrf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= 10),
{_TOP[_TOP.index("terms AS (SELECT *, list_filter"):]}"""
SQL["context_query"] = f"""WITH RECURSIVE {_BATCH}, {_ENT}, {_expand_sql(_WAY)}, {_ASSEMBLED},
sure AS (SELECT query_id, least(1.0, sum(pow(0.7, rn - 1) * greatest(score, 0)) / sum(pow(0.7, rn - 1))) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rn FROM own) WHERE rn <= 5 GROUP BY 1)
SELECT query_id, true AS retrieve, CASE WHEN query_id IN (SELECT query_id FROM named) THEN 'mention' WHEN intent IN ('find', 'list', 'debug') THEN 'intent' ELSE 'default' END AS reason, coalesce(context, '') AS context, coalesce(tokens, 0) AS tokens,
  coalesce(sources, '') AS sources, coalesce(truncated, false) AS truncated, round(coalesce(a.confidence, 0)::DOUBLE, 6) AS confidence FROM parsed p LEFT JOIN assembled USING (query_id) LEFT JOIN sure a USING (query_id)"""
