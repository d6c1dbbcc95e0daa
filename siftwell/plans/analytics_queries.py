"""Queries on counts, memory, feedback, conversations and changes.

Events stand in for tables that the data lack: feedback (purchase, error, click and view as signals on the
user as entity) and memory items (one per event, a session per user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import queries as Q
from siftwell.functions import text as T
from siftwell.operators import analytics as A
from siftwell.operators import changes, fusion
from siftwell.operators import entities as E
from siftwell.operators import messages as M
from siftwell.plans.search_queries import _ENT, ents, r6
from siftwell.runtime import read


def feedback(spark: SparkSession, d: str) -> DataFrame:
    s = F.create_map(*[F.lit(x) for x in ("purchase", "explicit_positive", "error", "explicit_negative", "click", "used", "view", "ignored")])
    return read(spark, d, "events").select(F.col("user_id").alias("entity_id"), s[F.col("event_type")].alias("signal")).where("signal is not null")


_FEEDBACK = """fb AS (SELECT user_id AS entity_id, MAP {'purchase': 'explicit_positive', 'error': 'explicit_negative', 'click': 'used', 'view': 'ignored'}[event_type] AS signal FROM events WHERE event_type <> 'signup'),
st AS (SELECT entity_id, count(*) AS total, count(*) FILTER (signal = 'used') AS used, count(*) FILTER (signal = 'ignored') AS ignored,
  count(*) FILTER (signal = 'explicit_positive') AS positive, count(*) FILTER (signal = 'explicit_negative') AS negative FROM fb GROUP BY 1)"""


def memory(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_type") == "purchase", "hot").when(F.col("event_type").isin("click", "view"), "warm").otherwise("cold")
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), t.alias("tier"), F.ceil("value").cast("int").alias("token_count"),
        (F.col("value") / 500).alias("relevance_score"), F.get_json_object("props", "$.k").cast("int").alias("access_count"), F.col("ts").alias("created_at"),
    )


_MEMORY = """mem AS (SELECT event_id AS id, user_id AS session_id, CASE WHEN event_type = 'purchase' THEN 'hot' WHEN event_type IN ('click', 'view') THEN 'warm' ELSE 'cold' END AS tier,
  ceil(value)::INT AS token_count, value / 500 AS relevance_score, json_extract_string(props, '$.k')::INT AS access_count, ts AS created_at FROM events)"""


def msgs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "messages").where("session_id is not null").dropDuplicates(["id"])


_MSG = "msg AS (SELECT DISTINCT ON (id) * FROM messages WHERE session_id IS NOT NULL)"
_MORD = "created_at NULLS FIRST, position NULLS FIRST, id"


def entity_type_stats(spark, d):
    return A.entity_stats(ents(spark, d))


def coverage_by_type(spark, d):
    return A.embedding_coverage(ents(spark, d), read(spark, d, "vectors")).withColumn("coverage", r6("coverage"))


def summary_coverage(spark, d):
    return A.summary_coverage(ents(spark, d)).withColumn("coverage", r6("coverage"))


def vectors_by_model(spark, d):
    return A.vectors_by_model(read(spark, d, "vectors"))


def orphans_anti(spark, d):
    return A.orphan_vectors(read(spark, d, "vectors"), read(spark, d, "entities")).select("entity_id", "model_id", "chunk_index").distinct()


def exists_semi(spark, d):
    return ents(spark, d).select("id", "type").join(read(spark, d, "vectors").select(F.col("entity_id").alias("id")), "id", "left_semi")


def stale_vectors(spark, d):
    e = ents(spark, d).select("id", T.content_hash(F.col("content")).alias("entity_hash"))
    return A.stale_vectors(read(spark, d, "vectors"), e).select("entity_id", "model_id").distinct()


def entities_to_embed(spark, d):
    e = ents(spark, d).select("id", T.content_hash(F.col("content")).alias("entity_hash"))
    return changes.to_embed(e, read(spark, d, "vectors"), "nimbus-embed-64").select("id")


def health_report(spark, d):
    return A.health(ents(spark, d), read(spark, d, "relationships").dropDuplicates(["id"]), read(spark, d, "vectors")).withColumn("coverage", r6("coverage"))


def session_stats(spark, d):
    return A.session_stats(read(spark, d, "sessions").dropDuplicates(["id"]), msgs(spark, d))


def count_per_session_left(spark, d):
    return A.count_per_session(read(spark, d, "sessions"), msgs(spark, d))


def memory_tier_status(spark, d):
    return A.memory_status(memory(spark, d)).withColumn("utilization", r6("utilization"))


def memory_spill_candidates(spark, d):
    return A.spill_candidates(memory(spark, d)).select("session_id", "id", "to_tier")


def memory_prune_cold(spark, d):
    return A.prune_cold(memory(spark, d), 5).select("session_id", "id")


def feedback_stats(spark, d):
    return A.feedback_stats(feedback(spark, d)).withColumn("use_rate", r6("use_rate"))


def feedback_most_helpful(spark, d):
    return A.most_helpful(feedback(spark, d), 10)


def feedback_most_ignored(spark, d):
    return A.most_ignored(feedback(spark, d), 10).withColumn("ignore_rate", r6("ignore_rate"))


def feedback_adjusted_scores(spark, d):
    results = read(spark, d, "customer").select(F.lit(1).alias("query_id"), F.col("c_custkey").alias("entity_id"), (F.abs("c_acctbal") / 10000).alias("score"))
    return fusion.adjust_by_feedback(results, A.feedback_stats(feedback(spark, d))).select("entity_id", r6("score").alias("score"))


def reflection_summary(spark, d):
    return A.reflection_summary(read(spark, d, "reflections").dropDuplicates(["id"])).withColumn("success_rate", r6("success_rate"))


def reflection_common_failures(spark, d):
    r = read(spark, d, "reflections").dropDuplicates(["id"]).withColumn("all", F.lit(1))
    return A.common_phrases(r, "all", "failure", "what_did_not_work").select("phrase", "n", "rank")


def message_recent_k(spark, d):
    return M.recent(msgs(spark, d), 5).select("session_id", "id", F.col("nth").cast("int").alias("nth"))


def conversation_pairs(spark, d):
    return M.pairs(msgs(spark, d)).select("session_id", "id", F.col("pair").cast("int").alias("pair"))


def conversation_pairs_last(spark, d):
    return M.pairs(msgs(spark, d), 3).select("session_id", "id", F.col("pair").cast("int").alias("pair"))


def transcript(spark, d):
    """Whole sessions; messages without a time or position come first, as everywhere in the order of messages."""
    return M.transcript(msgs(spark, d)).select("session_id", F.length("transcript").alias("n_chars"), F.md5("transcript").alias("transcript_md5"))


def latest_n_per_session(spark, d):
    r = read(spark, d, "reflections").where("session_id is not null").dropDuplicates(["id"])
    return E.keep_latest(r, "session_id", [F.col("created_at").desc(), F.col("id")], 3).select("session_id", "id")


def next_attempt(spark, d):
    return E.next_number(read(spark, d, "reflections"), "session_id", "attempt_number")


def current_session(spark, d):
    return M.current_session(read(spark, d, "sessions"))


def due_for_summary(spark, d):
    return M.due_for_summary(msgs(spark, d), 20)


def decision_language_filter(spark, d):
    return msgs(spark, d).where(M.may_decide(F.col("content")) | M.has_phrase(F.col("content"))).select("id")


def intent_detect(spark, d):
    m = msgs(spark, d).where("content is not null")
    i = Q.intent(F.trim("content"))
    return m.select("id", i["intent"].alias("intent"), i["confidence"].alias("confidence"))


def gate_flags(spark, d):
    m = msgs(spark, d).where("content is not null")
    c = F.col("content")
    return m.select("id", Q.is_greeting(c).alias("greeting"), Q.is_confirmation(c).alias("confirmation"), Q.is_general(c).alias("general"))


def content_hash_changes(spark, d):
    """Documents against a copy in which a part is changed, a part is missing and a part is new."""
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    old = docs.where("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.md5("hash")).otherwise(F.col("hash")))
    return changes.diff(old, docs.where("doc_id % 11 <> 0"), "doc_id", "hash")


def duplicate_text_groups(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def line_range_merge(spark, d):
    e = ents(spark, d).where("file_path is not null and start_line is not null and end_line >= start_line")
    return changes.merge_ranges(e.select("file_path", "start_line", "end_line"), ["file_path"], "start_line", "end_line")


def split_identifier(spark, d):
    return ents(spark, d).select("id", F.array_join(F.array_sort(T.split_identifier(F.col("name"))), " ").alias("parts"))


def estimate_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def query_keywords(spark, d):
    n = Q.normalize(F.trim("summary"))
    none = F.array().cast("array<string>")
    return ents(spark, d).where("summary is not null").select("id", F.array_join(F.array_sort(Q.keywords(n, none)), " ").alias("keywords"))


def bigram_name_similarity(spark, d):
    """How alike the names at both ends of each relationship are."""
    e = ents(spark, d).where("name is not null")
    r = read(spark, d, "relationships").select("source_id", "target_id").distinct()
    x = r.join(e.select(F.col("id").alias("source_id"), F.col("name").alias("x")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("name").alias("y")), "target_id")
    return x.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), r6(T.name_similarity(F.col("x"), F.col("y"))).alias("similarity"))


def json_prop_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").where(k > 90).select("event_id", k.alias("k"))


def impact_risk_score(spark, d):
    """Suppliers as change sets: returned lines as deletions, others as changes."""
    li = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("report_id")).agg(
        A.n_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("n_deleted"), A.n_if(F.col("l_linestatus") == "O").alias("n_modified"),
        A.n_if(F.col("l_discount") > 0.0999).alias("n_widely_used"), A.n_if(F.col("l_tax") > 0.0799).alias("n_invalidated"),
    )
    return A.impact_risk(li)


def documents_by_language(spark, d):
    return ents(spark, d).select(T.language(F.col("file_path")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def chunk_count_estimate(spark, d):
    from siftwell.operators.chunks import estimate_count

    return read(spark, d, "documents").select("doc_id", estimate_count(F.coalesce(F.length("text"), F.lit(0))).alias("n_chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_type_stats, coverage_by_type, summary_coverage, vectors_by_model, orphans_anti, exists_semi, stale_vectors, entities_to_embed,
        health_report, session_stats, count_per_session_left, memory_tier_status, memory_spill_candidates, memory_prune_cold, feedback_stats,
        feedback_most_helpful, feedback_most_ignored, feedback_adjusted_scores, reflection_summary, reflection_common_failures,
        message_recent_k, conversation_pairs, conversation_pairs_last, transcript, latest_n_per_session, next_attempt, current_session, due_for_summary,
        decision_language_filter, intent_detect, gate_flags, content_hash_changes, duplicate_text_groups, line_range_merge,
        split_identifier, estimate_tokens, query_keywords, bigram_name_similarity, json_prop_filter, impact_risk_score,
        documents_by_language, chunk_count_estimate,
    )
}

_STOP = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
_BIG = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"
_SQLRE = "|".join(f"(?:{p})" for p in M.DECISION_PATTERNS).replace("'", "''")
_PHR = " OR ".join(f"contains(lower(content), '{p}')" for p in (x.replace("'", "''") for x in M.DECISION_PHRASES))
_CASES = " ".join(
    f"WHEN regexp_matches(lower(trim(content)), '{p}') THEN {{'i': '{i}', 'c': {w}::DOUBLE}}" for p, i, w in sorted(Q.INTENTS, key=lambda x: -x[2])
)
_GEN = "|".join(f"(?:{p[4:]})" for p in Q.GENERAL).replace("'", "''")
_GENW = " OR ".join(f"contains(lower(content), '{w}')" for w in Q.GENERAL_WORDS)
SQL = {
    "entity_type_stats": f"WITH {_ENT} SELECT type, count(*) AS n_entities, count(*) FILTER (length(summary) > 0) AS n_summary, count(*) FILTER (length(hash) > 0) AS n_hash, count(DISTINCT file_path) AS n_files FROM ent GROUP BY 1",
    "coverage_by_type": f"WITH {_ENT}, v AS (SELECT DISTINCT entity_id FROM vectors) SELECT type, count(*) AS n_entities, count(entity_id) AS n_embedded, round(count(entity_id) / count(*) * 100, 6) AS coverage FROM ent LEFT JOIN v ON id = entity_id GROUP BY 1",
    "summary_coverage": f"WITH {_ENT} SELECT type, count(*) AS n_entities, count(*) FILTER (length(summary) > 0) AS n_summary, round(count(*) FILTER (length(summary) > 0) / count(*) * 100, 6) AS coverage FROM ent GROUP BY ROLLUP (type)",
    "vectors_by_model": "SELECT model_id, count(*) AS n_vectors, count(DISTINCT entity_id) AS n_entities, count(*) - count(content_hash) AS n_without_hash FROM vectors GROUP BY 1",
    "orphans_anti": "SELECT DISTINCT entity_id, model_id, chunk_index FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = v.entity_id)",
    "exists_semi": f"WITH {_ENT} SELECT id, type FROM ent WHERE id IN (SELECT entity_id FROM vectors)",
    "stale_vectors": f"WITH {_ENT} SELECT DISTINCT entity_id, model_id FROM vectors JOIN ent ON id = entity_id WHERE content_hash IS DISTINCT FROM substring(sha256(content), 1, 16)",
    "entities_to_embed": f"WITH {_ENT} SELECT id FROM ent WHERE NOT EXISTS (SELECT 1 FROM vectors WHERE model_id = 'nimbus-embed-64' AND entity_id = id AND content_hash = substring(sha256(content), 1, 16))",
    "health_report": f"""WITH {_ENT}, v AS (SELECT DISTINCT entity_id FROM vectors), c AS (SELECT count(entity_id) / count(*) * 100 AS coverage FROM ent LEFT JOIN v ON id = entity_id),
o AS (SELECT count(DISTINCT id) AS n FROM relationships WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND (source_id NOT IN (SELECT id FROM ent) OR target_id NOT IN (SELECT id FROM ent)))
SELECT n AS n_orphan_edges, round(coverage, 6) AS coverage, CASE WHEN coverage >= 80 THEN 'ok' WHEN coverage >= 50 THEN 'warn' ELSE 'low' END AS verdict FROM c, o""",
    "session_stats": f"""WITH {_MSG}, s AS (SELECT DISTINCT ON (id) * FROM sessions) SELECT count(*) AS n_sessions, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status = 'archived') AS n_archived,
count(*) FILTER (status = 'summarized') AS n_summarized, (SELECT count(*) FROM msg WHERE session_id IN (SELECT id FROM sessions)) AS n_messages FROM s""",
    "count_per_session_left": f"WITH {_MSG}, s AS (SELECT DISTINCT id FROM sessions) SELECT s.id AS session_id, count(msg.id) AS n_messages FROM s LEFT JOIN msg ON msg.session_id = s.id GROUP BY 1",
    "memory_tier_status": f"""WITH {_MEMORY} SELECT session_id, {", ".join(f"count(*) FILTER (tier = '{t}') AS {t}_items, coalesce(sum(token_count) FILTER (tier = '{t}'), 0)::BIGINT AS {t}_tokens" for t in ("hot", "warm", "cold"))},
round(hot_tokens / 4000 * 100, 6) AS utilization, hot_tokens > 3600 AS hint_spill, cold_items > 1000 AS hint_prune FROM mem GROUP BY 1""",
    "memory_spill_candidates": f"WITH {_MEMORY} SELECT session_id, id, CASE WHEN access_count >= 3 THEN 'warm' ELSE 'cold' END AS to_tier FROM mem WHERE tier = 'hot' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY relevance_score, created_at, id) <= 4",
    "memory_prune_cold": f"WITH {_MEMORY} SELECT session_id, id FROM mem WHERE tier = 'cold' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY relevance_score + 0.1::DOUBLE * access_count DESC, id) > 5",
    "feedback_stats": f"WITH {_FEEDBACK} SELECT *, round(used / total, 6) AS use_rate FROM st",
    "feedback_most_helpful": f"WITH {_FEEDBACK} SELECT entity_id, used + 2 * positive - 2 * negative AS helpfulness FROM st WHERE helpfulness > 0 ORDER BY 2 DESC, 1 LIMIT 10",
    "feedback_most_ignored": f"WITH {_FEEDBACK} SELECT entity_id, round(ignored / total, 6) AS ignore_rate, total FROM st WHERE total >= 5 ORDER BY ignored / total DESC, 1 LIMIT 10",
    "feedback_adjusted_scores": f"""WITH {_FEEDBACK} SELECT c_custkey AS entity_id, round(abs(c_acctbal) / 10000 * CASE WHEN total >= 5 THEN
least(1.7, greatest(0.3, 0.5 + used / total + 0.1 * least(positive, 3) - 0.15 * least(negative, 3))) ELSE 1 END, 6) AS score FROM customer LEFT JOIN st ON entity_id = c_custkey""",
    "reflection_summary": "SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS n_success, round(count(*) FILTER (outcome = 'success') / count(*), 6) AS success_rate FROM (SELECT DISTINCT ON (id) * FROM reflections)",
    "reflection_common_failures": """WITH r AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM reflections) WHERE outcome = 'failure' ORDER BY created_at DESC, id DESC LIMIT 20),
p AS (SELECT lower(trim(unnest(what_did_not_work))) AS phrase FROM r), c AS (SELECT phrase, count(*) AS n FROM p WHERE phrase <> '' GROUP BY 1)
SELECT phrase, n, (row_number() OVER (ORDER BY n DESC, phrase))::INT AS rank FROM c QUALIFY rank <= 5""",
    "message_recent_k": f"""WITH {_MSG}, n AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY {_MORD}) AS rn, count(*) OVER (PARTITION BY session_id) AS c FROM msg)
SELECT session_id, id, (rn - greatest(c - 5, 0))::INT AS nth FROM n WHERE rn > c - 5""",
    "conversation_pairs": f"""WITH {_MSG}, n AS (SELECT session_id, id, role, row_number() OVER w AS pair, lead(role) OVER w AS r FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY {_MORD}))
SELECT session_id, id, pair::INT AS pair FROM n WHERE role = 'user' AND r = 'assistant'""",
    "conversation_pairs_last": f"""WITH {_MSG}, n AS (SELECT session_id, id, role, row_number() OVER w AS pair, lead(role) OVER w AS r FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY {_MORD}))
SELECT session_id, id, pair::INT AS pair FROM n WHERE role = 'user' AND r = 'assistant' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pair DESC) <= 3""",
    "transcript": f"""WITH {_MSG}, t AS (SELECT session_id, string_agg(concat_ws(': ', role, coalesce(content, '')), chr(10) || chr(10) ORDER BY {_MORD}) AS t FROM msg GROUP BY 1)
SELECT session_id, length(t)::INT AS n_chars, md5(t) AS transcript_md5 FROM t""",
    "latest_n_per_session": "SELECT session_id, id FROM (SELECT DISTINCT ON (id) * FROM reflections) WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id) <= 3",
    "next_attempt": "SELECT session_id, (coalesce(max(attempt_number), 0) + 1)::INT AS next FROM reflections GROUP BY 1",
    "current_session": "SELECT arg_max(id, (updated_at, id)) AS session_id FROM sessions WHERE status = 'active'",
    "due_for_summary": f"WITH {_MSG} SELECT session_id, count(*) AS n_messages FROM msg GROUP BY 1 HAVING count(*) >= 20",
    "decision_language_filter": f"WITH {_MSG} SELECT id FROM msg WHERE regexp_matches(content, '(?i){_SQLRE}') OR {_PHR}",
    "intent_detect": f"WITH {_MSG}, x AS (SELECT id, CASE {_CASES} ELSE {{'i': 'general', 'c': 0.3::DOUBLE}} END AS x FROM msg WHERE content IS NOT NULL) SELECT id, x.i AS intent, x.c AS confidence FROM x",
    "gate_flags": f"""WITH {_MSG} SELECT id, regexp_matches(trim(content), '(?i)^(hi|hello|hey|greetings|good\\s*(morning|afternoon|evening))|^(thanks|thank\\s*you|ty|thx)') AS greeting,
lower(trim(content)) IN ({", ".join(f"'{c}'" for c in Q.CONFIRMATIONS)}) AS confirmation,
CASE WHEN regexp_matches(content, '(?i){_GEN}') THEN NOT regexp_matches(content, '(?i)our|my|this|the project|codebase')
ELSE ({_GENW}) AND NOT regexp_matches(content, '(?i)our|my|this (project|codebase|system)') END AS general FROM msg WHERE content IS NOT NULL""",
    "content_hash_changes": """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(h) ELSE h END AS h FROM d WHERE doc_id % 7 <> 0), n AS (FROM d WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "duplicate_text_groups": "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "line_range_merge": f"""WITH {_ENT}, e AS (SELECT file_path, start_line, end_line FROM ent WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line),
f AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS i FROM f) SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file_path, i""",
    "split_identifier": f"""WITH {_ENT}, c AS (SELECT id, name, string_split_regex(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+') AS c FROM ent)
SELECT id, array_to_string(list_sort(list_distinct(list_concat([name, lower(name)], CASE WHEN len(c) > 1 THEN c ELSE [] END,
CASE WHEN contains(name, '_') THEN list_filter(string_split(name, '_'), lambda x: x <> '') ELSE [] END, CASE WHEN contains(name, '-') THEN list_filter(string_split(name, '-'), lambda x: x <> '') ELSE [] END))), ' ') AS parts FROM c""",
    "estimate_tokens": "SELECT doc_id, coalesce(ceil(length(text) / 4.0), 0)::INT AS tokens FROM documents",
    "query_keywords": f"""WITH {_ENT}, n AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(summary), '`([^`]+)`', '\\1', 'g'), '\\s+', ' ', 'g'), '[?!.]+$', '')) AS s FROM ent WHERE summary IS NOT NULL)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(s), '[\\s\\-_.,;:!?''"()\\[\\]{{}}]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[0-9]+$')))), ' ') AS keywords FROM n""",
    "bigram_name_similarity": f"""WITH {_ENT}, e AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS s FROM ent WHERE name IS NOT NULL),
b AS (SELECT *, {_BIG.format("s")} AS g FROM e)
SELECT DISTINCT x.id AS a, y.id AS b, round(CASE WHEN x.s = y.s THEN 1 WHEN len(list_distinct(list_concat(x.g, y.g))) = 0 THEN 0 ELSE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) END::DOUBLE, 6) AS similarity
FROM relationships r JOIN b x ON x.id = r.source_id JOIN b y ON y.id = r.target_id""",
    "json_prop_filter": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k')::INT > 90",
    "impact_risk_score": """WITH s AS (SELECT l_suppkey AS report_id, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS n_deleted, count(*) FILTER (l_linestatus = 'O') AS n_modified,
count(*) FILTER (l_discount > 0.0999) AS n_widely_used, count(*) FILTER (l_tax > 0.0799) AS n_invalidated FROM lineitem GROUP BY 1)
SELECT *, 2 * n_deleted + CASE WHEN n_modified > 10 THEN n_modified // 5 ELSE 0 END + 3 * n_widely_used + 2 * n_invalidated AS risk_score,
CASE WHEN risk_score >= 10 THEN 'high' WHEN risk_score >= 5 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
    "documents_by_language": f"""WITH {_ENT} SELECT coalesce(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items())}}}[lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))], '') AS language, count(*) AS n FROM ent GROUP BY 1""",
    "chunk_count_estimate": "SELECT doc_id, CASE WHEN coalesce(length(text), 0) <= 4000 THEN 1 ELSE ceil((length(text) - 200) / 3800.0) END::INT AS n_chunks FROM documents",
}
