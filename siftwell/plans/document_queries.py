"""Queries on documents, sections, events and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import providers
from siftwell.functions import code as C
from siftwell.operators import chunks, documents
from siftwell.plans.analytics_queries import _MEMORY, memory
from siftwell.plans.search_queries import _ENT, ents
from siftwell.runtime import read
from siftwell.sources import parsers
from siftwell.streaming import events as S
from siftwell.streaming import memory as SM


def sections(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "markdown_sections").dropDuplicates(["id"])


def overlap_chunks(spark, d):
    return chunks.chunk(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "start", "end")


def section_chunks(spark, d):
    return chunks.section_chunks(sections(spark, d), "id", "content").select("id", "chunk_index", F.length("piece").alias("n_chars"))


def code_chunks(spark, d):
    return chunks.code_chunks(ents(spark, d)).select("id", "chunk_index", "total", F.length("text").alias("n_chars"))


def markdown_parse(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return parsers.markdown(docs).select("path", "section_id", "title", "level", "parent", "start_line", "end_line")


def section_links(spark, d):
    return sections(spark, d).select("id", F.explode("links").alias("l")).select("id", F.col("l.url").alias("url"), F.col("l.is_internal").alias("is_internal")).distinct()


def section_tree(spark, d):
    """Sections with the title of the one that holds them."""
    s = sections(spark, d)
    return s.select("id", "title", "parent").join(s.select(F.col("id").alias("parent"), F.col("title").alias("parent_title")), "parent", "left").select("id", "title", "parent_title")


def code_block_languages(spark, d):
    return sections(spark, d).select(F.explode("code_blocks").alias("b")).groupBy(F.col("b.language").alias("language")).agg(F.count("*").alias("n"))


def html_extract(spark, d):
    """Documents wrapped as HTML and read again: title and text."""
    docs = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "source", F.translate("text", "<>", "  ").alias("t"))
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("source", F.lit("none")), F.lit("</title><style>x</style></head><body><!-- c --><p>"), "t", F.lit("</p></body></html>"))
    return parsers.html(docs.select("path", page.alias("content"))).select("path", "title", F.md5("text").alias("text_md5"))


def code_references(spark, d):
    return documents.code_references(sections(spark, d), "id", "content")


def entity_mentions(spark, d):
    return documents.mentions(sections(spark, d), "id", "content", ents(spark, d)).select("id", "name", "confidence")


def requirement_priorities(spark, d):
    s = sections(spark, d).where("content is not null")
    return s.select("id", documents.priority(F.col("content")).alias("priority"), documents.requirement_kind(F.col("content")).alias("kind"))


def critique(spark, d):
    """Assistant answers against the user's message before them as context, and three sources by name. Tested against fixtures; no SQL."""
    from siftwell.operators import messages as M
    from siftwell.plans.analytics_queries import msgs

    p = M.pairs(msgs(spark, d)).where("answer is not null and question is not null")
    drafts = p.select(F.col("id").alias("draft_id"), F.col("answer").alias("draft"), F.col("question").alias("context"), F.array(*map(F.lit, ("DurablePlanner", "readImporter", "gateway.ts"))).alias("names"))
    return documents.critique(drafts)


def json_documents(spark, d):
    """Reflections written as JSON documents: their top-level keys."""
    r = read(spark, d, "reflections").dropDuplicates(["id"]).select(F.concat("id", F.lit(".json")).alias("path"), F.to_json(F.struct("session_id", "outcome", "attempt_number", "tags")).alias("content"))
    return parsers.config_keys(r).groupBy("key", "kind").agg(F.count("*").alias("n"))


def session_window_debounce(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change"), "ts")
    return S.debounce(e, 3_600_000)


def tumbling_counts(spark, d):
    return S.windowed(read(spark, d, "events"), "1 day", "event_type")


def sliding_counts(spark, d):
    return S.windowed(read(spark, d, "events"), "2 days", "event_type", "1 day")


def memory_auto_spill(spark, d):
    return SM.auto_spill(memory(spark, d))


def mock_embeddings(spark, d):
    e = ents(spark, d).where("name is not null").select("id", "name")
    return providers.embed(e, "name", providers.MockEmbedding).select("id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").alias("dims"))


def code_summaries(spark, d):
    e = ents(spark, d).where("content is not null")
    return e.select("id", F.length(C.summarize(F.col("type"), F.col("content"))).alias("n_chars"), F.length(C.embedding_text(F.col("type"), F.col("name"), F.col("summary"), F.col("content"))).alias("n_embedded"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_chunks, section_chunks, code_chunks, markdown_parse, section_links, section_tree, code_block_languages, html_extract,
        code_references, entity_mentions, requirement_priorities, critique, json_documents, session_window_debounce,
        tumbling_counts, sliding_counts, memory_auto_spill, mock_embeddings, code_summaries,
    )
}
_SEC = "sec AS (SELECT DISTINCT ON (id) * FROM markdown_sections)"
def _chunk_sql(source: str) -> str:
    """CTEs that end in ``chunk`` (k, i, a, e, n), the last short one merged, from a CTE ``src`` (k, text, m most, o overlap, l least)."""
    cut = lambda p, n: f"WHEN regexp_matches(s, '{p}') THEN w + length(regexp_extract(s, '(?s)^(.*){p}', 1)) + {n}"
    end = f"CASE WHEN a + m >= n THEN n {cut(chr(92) + 'n' + chr(92) + 'n', 2)} {cut(chr(92) + 'n', 1)} {cut('[.!?]' + chr(92) + 's', 2)} {cut(' ', 1)} ELSE a + m END"
    seen = "substring(text, greatest(a, a + m - o) + 1, a + m - greatest(a, a + m - o)) AS s, greatest(a, a + m - o) AS w"
    return f"""src AS ({source}), long AS (SELECT *, length(text) AS n FROM src WHERE length(text) > m),
walk(k, i, a, e, n) AS (SELECT k, 0, a, {end}, n FROM (SELECT *, 0 AS a, substring(text, m - o + 1, o) AS s, m - o AS w FROM long)
  UNION ALL SELECT k, i, a, {end}, n FROM (SELECT q.*, {seen} FROM (SELECT long.k, long.text, long.m, long.o, long.n, walk.i + 1 AS i, CASE WHEN e - o > a THEN e - o ELSE e END AS a FROM walk JOIN long ON long.k = walk.k WHERE e < long.n) q)),
chunk AS (SELECT k, i, a, CASE WHEN short THEN n ELSE e END AS e, n FROM (SELECT walk.*, lead(walk.e) OVER v = n AND n - lead(walk.a) OVER v < l AS short, i > 0 AND walk.e = n AND walk.e - walk.a < l AS gone
  FROM walk JOIN (SELECT k AS kk, l FROM src) z ON kk = walk.k WINDOW v AS (PARTITION BY walk.k ORDER BY i)) WHERE NOT gone
  UNION ALL SELECT k, 0, 0, length(text), length(text) FROM src WHERE length(text) <= m)"""


_HEAD = """p AS (SELECT *, string_split_regex(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+') AS c FROM ent),
h AS (SELECT id, coalesce(content, '') AS text, length(concat_ws(chr(10), type || ': ' || array_to_string(list_distinct(list_concat([name, lower(name)], CASE WHEN len(c) > 1 THEN c ELSE [] END,
  CASE WHEN contains(name, '_') THEN list_filter(string_split(name, '_'), lambda x: x <> '') ELSE [] END, CASE WHEN contains(name, '-') THEN list_filter(string_split(name, '-'), lambda x: x <> '') ELSE [] END)), ' '),
  CASE WHEN file_path <> '' THEN 'in ' || array_to_string(string_split(file_path, '/')[-2:], '/') END, CASE WHEN summary <> '' THEN summary END)) AS h FROM p)"""
_REF = {k: p.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b").replace("(?=[\\s),.]|$)", "(?:[\\s),.]|$)") for k, p in documents.REFERENCE_PATTERNS.items()}
#: Separators are doubled, as the pattern of paths takes one on either side.
_WIDE = "regexp_replace(content, '([\\s(),])', '\\1\\1', 'g')"
SQL = {
    "overlap_chunks": f"WITH RECURSIVE {_chunk_sql('SELECT doc_id AS k, coalesce(text, chr(32)[2:]) AS text, 4000 AS m, 200 AS o, 100 AS l FROM documents')} SELECT k AS doc_id, i::INT AS chunk_index, a::INT AS start, e::INT AS end FROM chunk",
    "code_chunks": f"""WITH RECURSIVE {_ENT}, {_HEAD}, {_chunk_sql("SELECT id AS k, text, greatest(151, 1024 - h - 2) AS m, 150 AS o, 100 AS l FROM h")}
SELECT id, i::INT AS chunk_index, count(*) OVER (PARTITION BY id) AS total, (h + CASE WHEN e > a THEN 2 + e - a ELSE 0 END)::INT AS n_chars FROM chunk JOIN h ON k = id""",
    "section_chunks": f"""WITH RECURSIVE {_SEC}, par AS (SELECT id, generate_subscripts(string_split_regex(content, '\\n\\n+'), 1) AS k, unnest(string_split_regex(content, '\\n\\n+')) AS p FROM sec WHERE length(content) > 3000),
w(id, k, held, pieces) AS (SELECT DISTINCT id, 0, '', []::VARCHAR[] FROM par UNION ALL SELECT w.id, par.k, CASE WHEN held = '' THEN p WHEN length(held) + length(p) > 1500 THEN right(held, 200) || chr(10) || chr(10) || p ELSE held || chr(10) || chr(10) || p END,
  CASE WHEN held <> '' AND length(held) + length(p) > 1500 THEN list_append(pieces, regexp_replace(held, '^\\s+|\\s+$', '', 'g')) ELSE pieces END FROM w JOIN par ON par.id = w.id AND par.k = w.k + 1),
d AS (SELECT id, CASE WHEN regexp_matches(held, '\\S') THEN list_append(pieces, regexp_replace(held, '^\\s+|\\s+$', '', 'g')) ELSE pieces END AS ps FROM w QUALIFY k = max(k) OVER (PARTITION BY id)),
l AS (SELECT id, generate_subscripts(ps, 1) AS k, length(unnest(ps)) AS n FROM d),
m(id, k, part, n) AS (SELECT id, k, 0, n FROM l WHERE k = 1 UNION ALL SELECT m.id, l.k, CASE WHEN m.n < 200 THEN part ELSE part + 1 END, CASE WHEN m.n < 200 THEN m.n + 2 + l.n ELSE l.n END FROM m JOIN l ON l.id = m.id AND l.k = m.k + 1)
SELECT id, part::INT AS chunk_index, max(n)::INT AS n_chars FROM m GROUP BY 1, 2 UNION ALL SELECT id, 0, coalesce(length(content), 0)::INT FROM sec WHERE coalesce(length(content), 0) <= 3000""",
    "code_references": f"WITH {_SEC}, b AS (SELECT id, content, regexp_replace(content, '`([^`]+)`', '', 'g') AS bare FROM sec WHERE content IS NOT NULL), r AS ("
    + " UNION ALL ".join(f"SELECT id, {i} AS o, '{k}' AS kind, unnest(regexp_extract_all({_WIDE if k == 'filepath' else 'content' if k == 'backtick' else 'bare'}, '{p}', 1)) AS ref FROM b" for i, (k, p) in enumerate(_REF.items()))
    + ") SELECT id, ref, arg_min(kind, o) AS kind FROM r GROUP BY 1, 2",
    "memory_auto_spill": f"""WITH RECURSIVE {_MEMORY}, e AS (SELECT session_id::VARCHAR AS s, id::VARCHAR AS i, token_count AS t, relevance_score AS r, epoch_us(created_at) / 1e6 AS a, access_count AS c,
  row_number() OVER (PARTITION BY session_id ORDER BY created_at, id::VARCHAR) AS rn FROM mem),
w(s, rn, hot, moves) AS (SELECT DISTINCT s, 0, []::STRUCT(r DOUBLE, a DOUBLE, i VARCHAR, t INT, c INT)[], []::STRUCT(i VARCHAR, f VARCHAR, t VARCHAR)[] FROM e
  UNION ALL SELECT s, rn, list_append(CASE WHEN spill THEN list_sort(hot)[5:] ELSE hot END, one),
    list_append(CASE WHEN spill THEN list_transform(list_sort(hot)[:4], lambda x: {{'i': x.i, 'f': 'hot', 't': CASE WHEN x.c >= 3 THEN 'warm' ELSE 'cold' END}}) ELSE [] END, {{'i': i, 'f': 'new', 't': 'hot'}})
  FROM (SELECT w.s, e.rn, w.hot, e.i, {{'r': e.r, 'a': e.a, 'i': e.i, 't': e.t, 'c': e.c}} AS one, coalesce(list_sum(list_transform(w.hot, lambda x: x.t)), 0) + e.t > 4000 AS spill FROM w JOIN e ON e.s = w.s AND e.rn = w.rn + 1)),
m AS (SELECT s, unnest(moves) AS m FROM w) SELECT s AS session_id, m.i AS id, m.f AS from_tier, m.t AS to_tier FROM m""",
    "markdown_parse": """WITH l AS (SELECT doc_id::VARCHAR AS path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, starts_with(line, '```') AS fence, count(*) FILTER (starts_with(line, '```')) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM l),
o AS (SELECT *, fence OR k % 2 = 1 AS fenced FROM f), h AS (SELECT path, pos, length(regexp_extract(line, '^(#{1,6})\\s+.+$', 1)) AS level, regexp_extract(line, '^#{1,6}\\s+(.+)$', 1) AS title FROM o WHERE NOT fenced AND regexp_full_match(line, '#{1,6}\\s+.+')),
n AS (SELECT path, max(pos) + 1 AS n FROM l GROUP BY 1),
s AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY path ORDER BY pos), n)::INT AS end_line, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section-' || (pos + 1)) AS section_id FROM h JOIN n USING (path)),
p AS (SELECT a.path, a.pos, arg_max(b.section_id, b.pos) AS parent FROM s a JOIN s b ON a.path = b.path AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2),
t AS (SELECT o.path, min(s.pos)::INT AS first_at FROM o JOIN s ON s.path = o.path GROUP BY 1)
SELECT path, section_id, title, level::INT AS level, parent, (pos + 1)::INT AS start_line, end_line FROM s LEFT JOIN p USING (path, pos)
UNION ALL SELECT DISTINCT path, 'preamble', 'Preamble', 0, NULL, 1, first_at FROM t JOIN o USING (path) WHERE pos < first_at AND NOT fenced AND regexp_matches(line, '\\S')""",
    "section_links": f"WITH {_SEC} SELECT DISTINCT id, l.url AS url, l.is_internal AS is_internal FROM (SELECT id, unnest(links) AS l FROM sec)",
    "section_tree": f"WITH {_SEC} SELECT s.id, s.title, p.title AS parent_title FROM sec s LEFT JOIN sec p ON p.id = s.parent",
    "code_block_languages": f"WITH {_SEC} SELECT b.language AS language, count(*) AS n FROM (SELECT unnest(code_blocks) AS b FROM sec) GROUP BY 1",
    "html_extract": """WITH t AS (SELECT doc_id, coalesce(source, 'none') AS source, translate(text, '<>', '  ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS path, source AS title, md5(trim(regexp_replace(source || ' ' || t, '\\s+', ' ', 'g'))) AS text_md5 FROM t""",
    "requirement_priorities": f"""WITH {_SEC} SELECT id, CASE {" ".join(f"WHEN regexp_matches(content, '(?i)\\b(?:{w.replace(chr(39), chr(39) * 2)})\\b') THEN '{p}'" for p, w in documents.PRIORITIES)} END AS priority,
CASE WHEN regexp_matches(content, '{documents.USER_STORY}') THEN 'user-story' WHEN regexp_matches(content, '(?i)constraint|limitation|restriction|must not|cannot') THEN 'constraint'
WHEN regexp_matches(content, '(?i)feature|capability|ability to|support for') THEN 'feature' ELSE 'requirement' END AS kind FROM sec WHERE content IS NOT NULL""",
    "entity_mentions": f"""WITH {_ENT}, {_SEC}, m AS (
  SELECT id, replace(unnest(regexp_extract_all(content, '`([A-Za-z_][A-Za-z0-9_.]*(?:\\(\\))?)`', 1)), '()', '') AS name, 0 AS o, 0.95::DOUBLE AS c FROM sec
  UNION ALL SELECT id, unnest(regexp_extract_all(content, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)), 1, 0.8 FROM sec
  UNION ALL SELECT id, unnest(regexp_extract_all(content, '\\b((?:src|lib|test|tests)/[A-Za-z0-9_/.-]+\\.[A-Za-z0-9_]+)\\b', 1)), 2, 0.9 FROM sec)
SELECT id, name, arg_min(c, o) AS confidence FROM m WHERE name IN (SELECT name FROM ent WHERE name IS NOT NULL) GROUP BY 1, 2""",
    "json_documents": """WITH r AS (SELECT DISTINCT ON (id) * FROM reflections)
SELECT key, kind, n FROM (SELECT 'session_id' AS key, 'variable' AS kind, count(session_id) AS n FROM r UNION ALL SELECT 'outcome', 'variable', count(outcome) FROM r
UNION ALL SELECT 'attempt_number', 'variable', count(attempt_number) FROM r UNION ALL SELECT 'tags', 'component', count(tags) FROM r) WHERE n > 0""",
    "mock_embeddings": f"""WITH {_ENT}, h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM ent WHERE name IS NOT NULL),
s AS (SELECT id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END::DOUBLE AS h FROM h),
v AS (SELECT id, list_transform(range(1, 129), lambda i: sin(h * i * 0.0001::DOUBLE)) AS v FROM s)
SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, 128::INT AS dims FROM v""",
    "session_window_debounce": """WITH e AS (SELECT user_id::VARCHAR AS path, event_type AS change, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts) AS i FROM f)
SELECT path, min(ts) AS first_at, max(ts) AS last_at, arg_max(change, (ts, change)) AS change, count(*) AS n_events FROM g GROUP BY path, i""",
    "tumbling_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, event_type, count(*) AS n_events FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2",
}
