"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import conversations as C
from siftwell.llm import golay, mixing, packing, spans, splitting, vptree
from siftwell.operators.components import components
from siftwell.runtime import materialize, read


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, d, "markdown_sections").select("id", F.col("content").alias("text"))
    b = read(spark, d, "pdf_documents").select("id", F.col("full_text").alias("text"))
    return golay.near_duplicates(a.unionByName(b), "id", "text", width=3, threshold=0.7, least=30)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return golay.expand(*_near(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its class of equal shingle sets, the links of that class, and the group that links join."""
    members, pairs = _near(spark, d)
    pairs = materialize(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = components(pairs, "a", "b").toDF("class_id", "group_id")
    return (
        members.join(links, "class_id", "left")
        .join(groups, "class_id", "left")
        .select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "vectors").select(
        F.col("model_id").alias("collection"),
        F.concat("entity_id", F.lit("#"), F.col("chunk_index").cast("string")).alias("key"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    r = read(spark, d, "reflections").select(
        F.lit("reflections").alias("collection"), F.col("id").alias("key"), vptree.parse_json(F.col("embedding_json")).alias("vector")
    )
    return vptree.usable(v.where(F.col("collection").isNotNull()).unionByName(r), "vector")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = vptree.neighbours(_vectors(spark, d), k=10, least=0.9)
    return found.select("collection", F.least("key", "other").alias("a_key"), F.greatest("key", "other").alias("b_key")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar others, whatever their cosine, of every key whose hash is divisible by 50. No SQL, as it is approximate."""
    asks = F.pmod(F.xxhash64("key"), F.lit(50)) == 0
    return vptree.neighbours(_vectors(spark, d), k=10, relax=0.5, queries=asks)


def _split_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "markdown_sections").select(F.col("id").alias("section_id"), "content", "start_line")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.boundary_kinds(_split_source(spark, d), "section_id", "content").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    sections = _split_source(spark, d).dropDuplicates(["section_id"])
    return splitting.split(sections, "section_id", "content", line="start_line")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "sessions").select(F.col("id").alias("session_id"))
    return a.unionByName(read(spark, d, "messages").select("session_id"))


def _threads(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return C.thread(C.clean(read(spark, d, "messages")), keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return C.dropped(_threads(spark, d), _sessions(spark, d))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    threads = _threads(spark, d, ("content",))
    kept = C.turns(threads, C.dropped(threads, _sessions(spark, d)))
    return kept.select("session_id", "turn", "speaker", "content", "created_at")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as texts, one turn a line, in parts of a thousand turns."""
    lines = F.transform("turns", lambda t: F.concat(t["speaker"], F.lit(": "), t["content"]))
    return C.conversations(p5_turns(spark, d)).select("session_id", "part", "n_turns", F.array_join(lines, "\n").alias("turns"))


def _limits(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return sorted((r[0], int(r[1])) for r in read(spark, d, "pack_limits").collect())


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), "doc_id", "text", _limits(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_containers(spark, d), _limits(spark, d))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: no container over its capacity, all texts whole and in place, little room left."""
    limits = _limits(spark, d)
    packed = materialize(p6_containers(spark, d))
    pieces = packed.groupBy("limit_name", "doc_id").agg(
        F.count("container_id").alias("n"), (F.max("token_end") - F.sum("n_tokens")).alias("gap"), F.min("token_start").alias("first"), F.max("piece").alias("last"), F.max("n_tokens").alias("most")
    )
    whole = (F.col("gap") == 0) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    texts = pieces.groupBy("limit_name").agg(
        F.sum((F.col("n") > 0).cast("int")).alias("n_texts"), F.sum((F.col("n") == 0).cast("int")).alias("n_null"), F.min(F.when(F.col("n") > 0, whole)).alias("whole")
    )
    cap = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("limit_name")]
    full = packing.fill(packed, limits).select("limit_name", (F.col("fullest") <= cap).alias("within"), (F.col("fill") > 0.95).alias("well_filled"))
    return texts.join(full, "limit_name")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix: shares met to a hundredth, no document over its source's cap, none without a text used."""
    uses, report = mixing.mix(read(spark, d, "documents"), "doc_id", "text", "source", read(spark, d, "mix_targets"))
    per = uses.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("copies").alias("most"), F.sum(F.when(F.col("n_tokens").isNull(), F.col("copies")).otherwise(0)).alias("of_null"))
    share = F.abs(F.col("actual_share") - F.col("wanted_share")) < 0.01
    return report.join(per, "source", "left").select(
        "source", F.round("wanted_share", 6).alias("wanted_share"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), share.alias("met"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within"), F.coalesce("of_null", F.lit(0)).alias("of_null"),
    )


def p7_use_counts(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), "doc_id", "text", "source", read(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), "doc_id", "text", "source", read(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read(spark, d, "documents"), "doc_id", "text")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(read(spark, d, "documents"), p8_found(spark, d), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_turns": p5_turns,
    "p5_conversations": p5_conversations,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_kept": p6_kept,
    "p7_use_counts": p7_use_counts,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
}

_W = r"[ \t\r\n\f]"
_P5 = f"""
WITH cleaned AS (
  SELECT session_id, content, created_at, min(position) AS position, min(id) AS id,
    CASE WHEN lower(regexp_replace(role, '^{_W}+|{_W}+$', '', 'g')) IN ('user', 'human') THEN 'user'
         WHEN lower(regexp_replace(role, '^{_W}+|{_W}+$', '', 'g')) IN ('assistant', 'ai', 'bot') THEN 'assistant'
         WHEN lower(regexp_replace(role, '^{_W}+|{_W}+$', '', 'g')) = 'system' THEN 'system' END AS speaker
  FROM messages WHERE session_id IS NOT NULL AND regexp_matches(content, '[^ \\t\\r\\n\\f]')
  GROUP BY session_id, role, content, created_at, CASE WHEN created_at IS NULL THEN id END
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS LAST, position NULLS LAST, id NULLS LAST) - 1 AS turn FROM cleaned
), facts AS (
  SELECT session_id, count(*) FILTER (speaker IN ('user', 'assistant')) AS n,
    bool_or(speaker IS NULL OR created_at IS NULL) AS bad,
    arg_min(coalesce(speaker, '?'), turn) FILTER (speaker IS DISTINCT FROM 'system') AS first_speaker,
    arg_max(coalesce(speaker, '?'), turn) FILTER (speaker IS DISTINCT FROM 'system') AS last_speaker
  FROM ordered GROUP BY session_id
), known AS (SELECT id AS session_id FROM sessions UNION SELECT session_id FROM messages),
dropped AS (
  SELECT session_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN bad OR first_speaker = 'assistant' THEN 'broken'
    WHEN last_speaker = 'user' THEN 'no_reply' END AS reason
  FROM known LEFT JOIN facts USING (session_id) WHERE session_id IS NOT NULL
)"""
_CUT = "chr(31)"
_P4 = f"""
WITH long AS (SELECT DISTINCT id AS section_id, content FROM markdown_sections WHERE length(content) > 3000),
cut AS (
  SELECT section_id,
    regexp_replace(content, '(?m)^((?:[ \\t\\r\\f]*\\n)+(?:[ \\t\\r\\f]+\\z)?)', '\\1' || {_CUT}, 'g') AS paragraph,
    regexp_replace(content, '(\\n)', '\\1' || {_CUT}, 'g') AS line,
    regexp_replace(content, '(\\n|。|[.!?]{_W})', '\\1' || {_CUT}, 'g') AS sentence,
    regexp_replace(content, '({_W}|。)', '\\1' || {_CUT}, 'g') AS word
  FROM long
), longest AS (
  SELECT section_id, {", ".join(f"list_max(list_transform(string_split({k}, {_CUT}), lambda x: length(x))) AS {k}" for k in ("paragraph", "line", "sentence", "word"))}
  FROM cut
)
SELECT section_id, CASE WHEN paragraph <= 2800 THEN 'paragraph' WHEN line <= 2800 THEN 'line'
  WHEN sentence <= 2800 THEN 'sentence' WHEN word <= 2800 THEN 'word' ELSE 'none' END AS boundary FROM longest"""
_P8 = """
WITH long AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
windows AS (SELECT doc_id, unnest(range(0, length(text) - 199)) AS s, text FROM long),
hashed AS (SELECT doc_id, s, md5(substring(text, s + 1, 200)) AS h FROM windows),
common AS (SELECT h FROM hashed GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, s FROM hashed JOIN common USING (h)),
flagged AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS nth FROM flagged)
SELECT doc_id, min(s)::INT AS span_start, (max(s) + 200)::INT AS span_end FROM numbered GROUP BY doc_id, nth"""
_P8_COVERAGE = f"""
WITH spans AS ({_P8}), per AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS c, count(*) AS k FROM spans GROUP BY 1)
SELECT doc_id, length(text)::INT AS n_chars, coalesce(c, 0) AS shared_chars, coalesce(k, 0) AS n_spans,
  CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) WHEN length(text) = 0 THEN 0.0 END::DOUBLE AS shared_share
FROM documents LEFT JOIN per USING (doc_id)"""
_P1 = """
WITH pool AS (SELECT id, content AS t FROM markdown_sections UNION SELECT id, full_text FROM pdf_documents),
w AS (SELECT id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM pool WHERE t IS NOT NULL),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS a_id, y.id AS b_id, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
SELECT a_id, b_id FROM c JOIN n x ON a_id = x.id JOIN n y ON b_id = y.id WHERE c >= 0.7 * (x.n + y.n - c)"""
_P1_GROUPS = _P1[: _P1.index(",\nc AS")] + """,
own AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS h FROM s GROUP BY id),
cls AS (SELECT id, min(id) OVER (PARTITION BY h) AS class_id FROM own),
rep AS (SELECT s.* FROM s JOIN cls USING (id) WHERE id = class_id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM rep x JOIN rep y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE c >= 0.7 * (x.n + y.n - c)),
two AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
k AS (SELECT a AS class_id, count(*) AS n_links FROM two GROUP BY a),
g(node, m) USING KEY (node) AS (SELECT a, min(b) FROM (SELECT a, b FROM two UNION SELECT a, a FROM two) GROUP BY a
  UNION SELECT two.b, min(g.m) FROM g JOIN two ON two.a = g.node JOIN recurring.g AS o ON o.node = two.b WHERE g.m < o.m GROUP BY two.b)
SELECT id, class_id, coalesce(n_links, 0) AS n_links, coalesce(m, class_id) AS group_id FROM cls LEFT JOIN k USING (class_id) LEFT JOIN g ON node = class_id"""
_P1_GROUPS = _P1_GROUPS.replace("WITH pool", "WITH RECURSIVE pool", 1)
_P4_PIECES = f"""
WITH RECURSIVE {_P4.strip()[5:_P4.strip().index("SELECT section_id, CASE WHEN paragraph")].strip()},
kind AS (SELECT section_id, CASE WHEN paragraph <= 2800 THEN 'paragraph' WHEN line <= 2800 THEN 'line' WHEN sentence <= 2800 THEN 'sentence' WHEN word <= 2800 THEN 'word' ELSE 'none' END AS boundary FROM longest),
parts AS (SELECT section_id, boundary, string_split(CASE boundary WHEN 'paragraph' THEN paragraph WHEN 'line' THEN line WHEN 'sentence' THEN sentence ELSE word END, {_CUT}) AS s FROM kind JOIN cut USING (section_id)),
lens AS (SELECT section_id, boundary, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM parts),
ends AS (SELECT section_id, boundary, (sum(length(x)) OVER (PARTITION BY section_id ORDER BY i))::INT AS e, length(x) AS n FROM lens),
places AS (SELECT DISTINCT section_id, p FROM (SELECT section_id, e AS p FROM ends UNION ALL SELECT section_id, 0 FROM kind
  UNION ALL SELECT section_id, unnest(range(e - n, e, 2800)) FROM ends WHERE n > 2800)),
succ AS (SELECT a.section_id, a.p, max(b.p) AS q FROM places a JOIN places b ON a.section_id = b.section_id AND b.p > a.p AND b.p <= a.p + 2800 GROUP BY 1, 2),
walk(section_id, i, p, q) AS (SELECT section_id, 0, p, q FROM succ WHERE p = 0 UNION ALL SELECT w.section_id, w.i + 1, s.p, s.q FROM walk w JOIN succ s ON s.section_id = w.section_id AND s.p = w.q),
sec AS (SELECT id AS section_id, any_value(content) AS content, any_value(start_line) AS start_line FROM markdown_sections GROUP BY id),
cuts AS (SELECT section_id, i, greatest(0, p - CASE WHEN i > 0 THEN 200 ELSE 0 END)::INT AS a, q::INT AS e, boundary FROM walk JOIN kind USING (section_id)
  UNION ALL SELECT section_id, 0, 0, length(content)::INT, 'whole' FROM sec WHERE length(content) BETWEEN 1 AND 3000)
SELECT section_id, i::INT AS chunk_index, a AS char_start, e AS char_end, boundary,
  (start_line + length(substring(content, 1, a)) - length(replace(substring(content, 1, a), chr(10), '')))::INT AS start_line, substring(content, a + 1, e - a) AS piece
FROM cuts JOIN sec USING (section_id)"""
_P3 = """
WITH raw AS (
  SELECT model_id AS collection, entity_id || '#' || chunk_index AS key, embedding::DOUBLE[] AS v FROM vectors WHERE model_id IS NOT NULL
  UNION ALL SELECT 'reflections', id, TRY_CAST(embedding_json AS JSON)::DOUBLE[] FROM reflections
    WHERE json_valid(embedding_json) AND json_type(embedding_json) = 'ARRAY'
), usual AS (
  SELECT collection, arg_max(n, (k, -n)) AS n FROM (SELECT collection, len(v) AS n, count(*) AS k FROM raw WHERE len(v) > 0 GROUP BY 1, 2) GROUP BY 1
), good AS (
  SELECT DISTINCT ON (collection, key) collection, key, v FROM raw JOIN usual USING (collection)
  WHERE len(v) = n AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = n AND len(list_filter(v, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT x.collection, x.key AS a, y.key AS b, list_cosine_similarity(x.v, y.v) AS c FROM good x JOIN good y ON x.collection = y.collection AND x.key <> y.key
), near AS (SELECT * FROM pairs WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY collection, a ORDER BY c DESC, b) <= 10)
SELECT DISTINCT collection, least(a, b) AS a_key, greatest(a, b) AS b_key FROM near"""
SQL = {
    "p3_found": _P3,
    "p1_found": _P1,
    "p1_groups": _P1_GROUPS,
    "p4_pieces": _P4_PIECES,
    "p5_conversations": f"""{_P5} SELECT session_id, (turn // 1000)::INT AS part, count(*)::INT AS n_turns,
  string_agg(speaker || ': ' || content, chr(10) ORDER BY turn) AS turns FROM ordered
WHERE session_id NOT IN (SELECT session_id FROM dropped WHERE reason IS NOT NULL) GROUP BY 1, 2""",
    "p6_kept": """SELECT limit_name, (SELECT count(text) FROM documents) AS n_texts, (SELECT count(*) FROM documents WHERE text IS NULL) AS n_null,
  true AS whole, true AS within, true AS well_filled FROM pack_limits""",
    "p7_kept": """WITH n AS (SELECT source, count(*) AS n, count(text) AS t FROM documents GROUP BY 1), w AS (SELECT sum(target_share) AS w FROM mix_targets JOIN n USING (source) WHERE t > 0)
SELECT source, round(CASE WHEN t > 0 THEN target_share / w ELSE 0 END, 6) AS wanted_share, coalesce(n, 0) AS n_documents, true AS met, true AS within, 0::BIGINT AS of_null
FROM mix_targets LEFT JOIN n USING (source) CROSS JOIN w""",
    "p8_found": _P8,
    "p8_coverage": _P8_COVERAGE,
    "p4_found": _P4,
    "p5_found": f"{_P5} SELECT session_id, reason FROM dropped WHERE reason IS NOT NULL",
    "p5_turns": f"""{_P5} SELECT session_id, turn, speaker, content, created_at FROM ordered
WHERE session_id NOT IN (SELECT session_id FROM dropped WHERE reason IS NOT NULL)""",
}
