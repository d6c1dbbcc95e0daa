"""Queries on lookups, changes of stored tables, and what sessions, decisions, checkpoints and suggestions are asked for.

Tables that the data lack are made of others: decisions and summaries of reflections, suggestions and checkpoints of events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators import agents, context, documents, fusion, resolve
from siftwell.operators import analytics as A
from siftwell.operators import entities as E
from siftwell.operators import graph as G
from siftwell.operators import messages as M
from siftwell.plans.analytics_queries import _MEMORY, _MSG, memory, msgs
from siftwell.plans.graph_queries import _EDGE, _STARTS, edges, starts
from siftwell.plans.search_queries import _ENT, ents, r6
from siftwell.runtime import materialize, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str):
    """Registers a query under its name with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# --- Entities -----------------------------------------------------------------------------------


@registered(f"WITH {_ENT} SELECT id, name FROM ent WHERE name = 'DurablePlanner' ORDER BY id LIMIT 1")
def entity_by_name(spark, d):
    return E.by_name(ents(spark, d), "DurablePlanner").select("id", "name")


@registered(f"WITH {_ENT} SELECT id, qualified_name FROM ent WHERE qualified_name = (SELECT min(qualified_name) FROM ent)")
def entity_by_qualified_name(spark, d):
    e = materialize(ents(spark, d).select("id", "qualified_name"))
    return e.where(F.col("qualified_name") == e.agg(F.min("qualified_name")).first()[0])


@registered(f"WITH {_ENT} SELECT id, start_line FROM ent WHERE file_path = (SELECT min(file_path) FROM ent)")
def entities_of_file(spark, d):
    e = materialize(ents(spark, d).select("id", "file_path", "start_line"))
    return E.by_file(e, e.agg(F.min("file_path")).first()[0]).select("id", "start_line")


@registered(f"WITH {_ENT} SELECT id, type FROM ent WHERE type IN ('class', 'interface')")
def entities_of_type(spark, d):
    return E.by_type(ents(spark, d), "class", "interface").select("id", "type")


@registered(f"WITH {_ENT} SELECT id, name FROM ent ORDER BY name NULLS FIRST, id LIMIT 50 OFFSET 100")
def entities_page(spark, d):
    return E.page(ents(spark, d), 50, 100).select("id", "name")


@registered(f"WITH {_ENT} SELECT id FROM ent WHERE id > (SELECT min(id) FROM ent) ORDER BY id LIMIT 500")
def entities_page_after(spark, d):
    e = materialize(ents(spark, d).select("id"))
    return E.page_after(e, e.agg(F.min("id")).first()[0], 500)


@registered(f"WITH {_ENT} SELECT id, hash FROM ent WHERE hash = (SELECT max(hash) FROM ent)")
def entities_of_hash(spark, d):
    e = materialize(ents(spark, d).select("id", "hash"))
    return E.by_hash(e, e.agg(F.max("hash")).first()[0])


@registered(f"WITH {_ENT} SELECT id, file_path FROM ent WHERE contains(file_path, 'src/') AND type = 'class'")
def entities_in_path(spark, d):
    return E.in_file(ents(spark, d), "src/", "class").select("id", "file_path")


@registered(f"WITH {_ENT} SELECT id FROM ent WHERE contains(lower(file_path), 'gateway') OR contains(lower(name), 'gateway') OR contains(lower(summary), 'gateway')")
def symbol_search(spark, d):
    return E.symbols(ents(spark, d), "Gateway").select("id")


@registered(f"WITH {_ENT} SELECT id FROM ent WHERE type = 'class' AND coalesce(start_line, 0) % 3 <> 0 AND coalesce(end_line, 0) % 2 = 0")
def instructions_list(spark, d):
    """Classes taken as team instructions: active, of high priority, with a tag."""
    n = F.coalesce("start_line", F.lit(0)) % 3 == 0
    meta = F.create_map(
        F.lit("active"), F.when(n, "false").otherwise("true"), F.lit("tags"), F.concat(F.lit("team , "), "type"),
        F.lit("priority"), F.when(F.coalesce("end_line", F.lit(0)) % 2 == 0, "high").otherwise("normal"),
    )
    e = ents(spark, d).select("id", F.lit("instruction").alias("type"), meta.alias("metadata"))
    return E.instructions(e, "class", "high").select("id")


@registered(f"""WITH {_ENT} SELECT id, CASE WHEN type = 'class' THEN concat(name, '2') ELSE name END AS name, created_at FROM ent
UNION ALL SELECT id || '-n', name, NULL FROM ent WHERE type = 'function'""")
def entity_upsert(spark, d):
    """Classes renamed by an upsert that keeps created_at, and copies of the functions added."""
    e = materialize(ents(spark, d).select("id", "type", "name", "created_at"))
    none = F.lit(None).cast("timestamp")
    new = e.where("type = 'class'").withColumn("name", F.concat("name", F.lit("2"))).withColumn("created_at", none)
    more = e.where("type = 'function'").withColumn("id", F.concat("id", F.lit("-n"))).withColumn("created_at", none)
    return E.upsert(e, new.unionByName(more), ["id"], keep=("created_at",)).select("id", "name", "created_at")


@registered(f"""WITH {_ENT} SELECT id, CASE WHEN type = 'function' AND content IS NOT NULL THEN substring(sha256(content || '!'), 1, 16) ELSE hash END AS hash,
  CASE WHEN type = 'function' THEN 'yes' END AS seen FROM ent""")
def entity_update(spark, d):
    """Functions get other content and a new key in their metadata: hashed anew, merged."""
    e = materialize(ents(spark, d).select("id", "type", "content", "hash", "metadata"))
    change = e.where("type = 'function'").select("id", F.concat("content", F.lit("!")).alias("content"), F.create_map(F.lit("_seen"), F.lit("yes")).alias("metadata"))
    return E.update(e, change).select("id", "hash", F.col("metadata")["_seen"].alias("seen"))


@registered(f"WITH {_ENT} SELECT type, count(*) AS n_deleted FROM ent WHERE type IN ('file', 'variable') GROUP BY 1")
def entity_delete_counts(spark, d):
    gone = spark.sql("SELECT * FROM VALUES ('file'), ('variable'), ('none such') AS t(type)")
    return E.deleted(ents(spark, d), gone, "type")


@registered(f"WITH {_ENT} SELECT id FROM ent WHERE type NOT IN ('file', 'variable')")
def entity_delete(spark, d):
    return E.delete(ents(spark, d).select("id", "type"), spark.sql("SELECT * FROM VALUES ('file'), ('variable') AS t(type)"), "type").select("id")


@registered(f"""WITH {_ENT}, {_EDGE}, g AS (SELECT id FROM ent WHERE type = 'class')
SELECT 'entities' AS table_name, count(*) AS n FROM ent WHERE id NOT IN (FROM g)
UNION ALL SELECT 'edges', count(*) FROM edge WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g)
UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE entity_id NOT IN (FROM g)""")
def entity_delete_cascade(spark, d):
    e = materialize(ents(spark, d).select("id", "type"))
    parts = E.delete_cascade(e, edges(spark, d), read(spark, d, "vectors").where("entity_id is not null"), e.where("type = 'class'"))
    out = [p.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, p in zip(("entities", "edges", "vectors"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@registered("""WITH v AS (SELECT DISTINCT entity_id, model_id, chunk_index FROM vectors WHERE entity_id IS NOT NULL AND model_id IS NOT NULL),
n AS (SELECT DISTINCT entity_id, model_id FROM v WHERE chunk_index = 0 AND model_id = 'nimbus-embed-64')
SELECT entity_id, model_id, chunk_index FROM v WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.entity_id = v.entity_id AND n.model_id = v.model_id) UNION ALL SELECT entity_id, model_id, 0 FROM n""")
def vector_store(spark, d):
    """The first chunks of one model stored anew: the other chunks of their entities go."""
    v = materialize(read(spark, d, "vectors").where("entity_id is not null and model_id is not null").select("entity_id", "model_id", "chunk_index").distinct())
    return E.store_vectors(v, v.where("chunk_index = 0 and model_id = 'nimbus-embed-64'"))


@registered("SELECT entity_id, model_id, count(*) AS n_chunks, max(len(embedding))::INT AS dims FROM vectors WHERE entity_id IS NOT NULL GROUP BY 1, 2")
def vector_lookup(spark, d):
    """What is stored of each entity and model: has a vector, how many chunks, of how many numbers."""
    return read(spark, d, "vectors").where("entity_id is not null").groupBy("entity_id", "model_id").agg(F.count("*").alias("n_chunks"), F.max(F.size("embedding")).alias("dims"))


@registered("""SELECT 'sessions' AS table_name, count(*) AS n_rows, 'id' AS column_name, 'string' AS column_type FROM sessions UNION ALL SELECT 'pack_limits', count(*), 'limit_name', 'string' FROM pack_limits
UNION ALL SELECT 'pack_limits', count(*), 'capacity_tokens', 'int' FROM pack_limits""")
def table_inspect(spark, d):
    return A.inspect({"sessions": read(spark, d, "sessions").select("id"), "pack_limits": read(spark, d, "pack_limits")})


# --- Edges --------------------------------------------------------------------------------------


@registered(f"WITH {_EDGE} SELECT id, CASE WHEN relationship = 'USES' THEN 0.5::DOUBLE ELSE weight END AS weight FROM edge")
def edge_set_weight(spark, d):
    e = materialize(edges(spark, d))
    return E.set_columns(e, e.where("relationship = 'USES'"), {"weight": F.lit(0.5)}).select("id", "weight")


@registered(f"WITH {_EDGE} SELECT id, weight FROM edge WHERE relationship = 'USES' AND weight >= 0.8 ORDER BY weight DESC, id LIMIT 100")
def edge_heaviest(spark, d):
    return G.clean(read(spark, d, "relationships"), ["USES"], 0.8).orderBy(F.col("weight").desc(), "id").limit(100).select("id", "weight")


@registered(f"""WITH {_EDGE} SELECT DISTINCT source_id, target_id FROM edge e WHERE EXISTS (SELECT 1 FROM edge f WHERE f.source_id = e.target_id AND f.target_id = e.source_id)""")
def edge_exists_back(spark, d):
    """Pairs that have an edge and one back."""
    e = edges(spark, d).select("source_id", "target_id").distinct()
    return e.join(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), ["source_id", "target_id"], "left_semi")


@registered(f"WITH {_ENT}, {_EDGE} SELECT edge.id, t.name AS target_name FROM edge LEFT JOIN ent t ON t.id = target_id")
def edge_target_names(spark, d):
    """Edges with the name of their target, null where it is none."""
    t = ents(spark, d).select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges(spark, d).join(t, "target_id", "left").select("id", "target_name")


@registered(f"WITH {_EDGE} SELECT id FROM edge WHERE relationship <> 'RELATES_TO' OR weight >= 0.6")
def edge_prune_links(spark, d):
    return resolve.prune_links(edges(spark, d)).select("id")


_DUP = f"""{_ENT}, {_EDGE}, g AS (SELECT id, min(id) OVER (PARTITION BY name, type) AS p FROM ent WHERE name IS NOT NULL AND type = 'class')"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Classes of one name as duplicates of the one with the least id."""
    e = ents(spark, d).where("name is not null and type = 'class'")
    return materialize(e.join(e.groupBy("name").agg(F.min("id").alias("primary_id")), "name").select("id", "primary_id"))


@registered(f"""WITH {_DUP}, m AS (SELECT edge.id, coalesce(s.p, source_id) AS a, coalesce(t.p, target_id) AS b, relationship, source_id = target_id AS was FROM edge
  LEFT JOIN g s ON s.id = source_id LEFT JOIN g t ON t.id = target_id)
SELECT min(id) AS id, a AS source_id, b AS target_id, relationship FROM m WHERE a <> b OR was GROUP BY a, b, relationship""")
def edge_redirect(spark, d):
    return G.redirect(edges(spark, d), _groups(spark, d)).select("id", "source_id", "target_id", "relationship")


@registered(f"WITH {_DUP} SELECT id FROM ent WHERE id NOT IN (SELECT id FROM g WHERE id <> p)")
def entity_merge(spark, d):
    return resolve.merge(ents(spark, d), _groups(spark, d)).select("id")


@registered(f"""WITH {_ENT}, k AS (SELECT id, name FROM ent WHERE type = 'constant')
SELECT DISTINCT k.id AS source_id, ent.id AS target_id FROM k JOIN ent USING (name) WHERE k.id <> ent.id""")
def edge_configures(spark, d):
    """Constants as configuration keys of what bears their name."""
    e = ents(spark, d)
    return resolve.configures(e.where("type = 'constant'"), e).select("source_id", "target_id")


@registered(f"""WITH {_ENT}, f AS (SELECT id, file_path FROM ent WHERE type = 'file' AND file_path IS NOT NULL), p AS (SELECT DISTINCT id AS source_id, regexp_replace(file_path, '\\.(ts|tsx|js|jsx)$', '') AS path FROM f),
s(suffix, o) AS (VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('/index.ts', 5), ('/index.js', 6))
SELECT source_id, path, arg_min(f.id, (o, f.id)) AS target_id FROM p, s JOIN f ON f.file_path = path || suffix GROUP BY 1, 2""")
def import_resolution(spark, d):
    """Every file imported by its path without the suffix."""
    e = ents(spark, d)
    paths = e.where("type = 'file' and file_path is not null").select(F.col("id").alias("source_id"), F.regexp_replace("file_path", r"\.(ts|tsx|js|jsx)$", "").alias("path")).distinct()
    return resolve.imports(paths, e)


@registered(f"""WITH RECURSIVE {_EDGE}, {_STARTS}, r(start, node) AS (SELECT node, node FROM starts
  UNION SELECT start, source_id FROM r JOIN edge ON target_id = r.node AND lower(relationship) IN ('imports', 'depends_on', 'uses'))
SELECT start, node FROM r WHERE start <> node""")
def transitive_dependents(spark, d):
    return G.transitive(edges(spark, d), starts(spark, d), "in").select("start", "node")


# --- Messages, sessions, decisions --------------------------------------------------------------


@registered(f"WITH {_MSG} SELECT id FROM msg WHERE role = 'user' AND created_at > TIMESTAMPTZ '2024-03-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2024-09-01 00:00:00+00'")
def message_list(spark, d):
    utc = dt.timezone.utc
    return M.query(msgs(spark, d), "user", dt.datetime(2024, 3, 1, tzinfo=utc), dt.datetime(2024, 9, 1, tzinfo=utc)).select("id")


@registered(f"""WITH {_MSG}, g AS (SELECT DISTINCT id FROM sessions WHERE status = 'archived') SELECT session_id, count(*) AS n_messages FROM msg WHERE session_id NOT IN (FROM g) GROUP BY 1""")
def message_delete_by_session(spark, d):
    """Messages of archived sessions deleted; the counters of what is left."""
    gone = read(spark, d, "sessions").where("status = 'archived'").select(F.col("id").alias("session_id"))
    return E.delete(msgs(spark, d), gone, "session_id").groupBy("session_id").agg(F.count("*").alias("n_messages"))


@registered(f"""WITH {_MSG}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, position NULLS FIRST, id) AS rn FROM msg)
SELECT session_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
  string_agg(substring(coalesce(content, ''), 1, 80), '; ' ORDER BY rn) FILTER (rn <= 5) AS beginnings FROM n GROUP BY 1""")
def session_template_summary(spark, d):
    x = M.template_summary(msgs(spark, d))
    return x.select("session_id", F.coalesce("n_user", F.lit(0)).alias("n_user"), F.coalesce("n_assistant", F.lit(0)).alias("n_assistant"), "beginnings")


_NOW = dt.datetime(2024, 12, 1, tzinfo=dt.timezone.utc)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sessions").dropDuplicates(["id", "status", "archived_at"])


@registered("SELECT DISTINCT id FROM sessions WHERE status IN ('archived', 'summarized') AND archived_at < TIMESTAMPTZ '2024-12-01 00:00:00+00' - INTERVAL 30 DAY")
def session_expired(spark, d):
    return M.expired(_sessions(spark, d), _NOW).select("id").distinct()


@registered("""WITH s AS (SELECT DISTINCT id, status, archived_at, updated_at FROM sessions)
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM s WHERE status = 'active') THEN 'archived' ELSE status END AS status,
  CASE WHEN id IN (SELECT id FROM s WHERE status = 'active') THEN TIMESTAMPTZ '2024-12-01 00:00:00+00' ELSE archived_at END AS archived_at FROM s""")
def session_archive(spark, d):
    """Every active session archived."""
    s = _sessions(spark, d)
    return M.archive(s, s.where("status = 'active'"), _NOW).select("id", "status", "archived_at").distinct()


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Reflections as decisions."""
    r = read(spark, d, "reflections").dropDuplicates(["id"])
    return r.select("id", "session_id", F.col("next_strategy").alias("description"), F.col("task_description").alias("context"), "related_entity_ids", F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"), "created_at", F.col("attempt_number").alias("version"))


_DEC = "dec AS (SELECT DISTINCT ON (id) id, session_id, next_strategy AS description, task_description AS context, related_entity_ids, created_at, attempt_number AS version FROM reflections)"


@registered(f"""WITH {_DEC}, n AS (SELECT id, lead(id) OVER (PARTITION BY session_id ORDER BY created_at, id) AS later FROM dec WHERE session_id IS NOT NULL AND created_at IS NOT NULL)
SELECT id, CASE WHEN later IS NULL THEN 'active' ELSE 'superseded' END AS status, later AS superseded_by FROM dec LEFT JOIN n USING (id)""")
def decision_supersede(spark, d):
    """Every decision superseded by the next one of its session."""
    x = materialize(_decisions(spark, d))
    after = F.lead("id").over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    change = x.where("session_id is not null and created_at is not null").select("id", after.alias("by")).where("by is not null")
    return M.supersede(x, change).select("id", "status", "superseded_by")


@registered(f"""WITH {_DEC}, u AS (SELECT id, unnest(related_entity_ids) AS e FROM dec) SELECT id FROM dec WHERE list_contains(related_entity_ids, (SELECT min(e) FROM u))""")
def decision_of_entity(spark, d):
    x = materialize(_decisions(spark, d))
    one = x.select(F.explode("related_entity_ids").alias("e")).agg(F.min("e")).first()[0]
    return M.decisions_of_entity(x, one).select("id")


_DECIDED = " OR ".join(f"contains(lower(content), '{w}')" for w in M.DECISION_WORDS)


@registered(f"""WITH {_DEC}, {_MSG}, h AS (SELECT id, CASE WHEN contains(lower(description), 'cache') THEN 1 WHEN contains(lower(context), 'cache') THEN 2 END AS tier, created_at FROM dec
  UNION ALL SELECT id, 3, created_at FROM msg WHERE contains(lower(content), 'cache') AND ({_DECIDED}))
SELECT id, tier::INT AS tier FROM h WHERE tier IS NOT NULL ORDER BY tier, created_at DESC NULLS LAST, id LIMIT 100""")
def decision_search(spark, d):
    return M.search_decisions(_decisions(spark, d), msgs(spark, d), "Cache", 100).select("id", "tier")


@registered(f"""WITH {_DEC} SELECT session_id, arg_max(id, (version, -ascii_rank)) AS id, max(version) AS version FROM (SELECT *, row_number() OVER (ORDER BY id) AS ascii_rank FROM dec WHERE version IS NOT NULL AND session_id IS NOT NULL) GROUP BY 1""")
def summary_latest_version(spark, d):
    return M.latest_version(_decisions(spark, d).where("version is not null and session_id is not null")).select("session_id", "id", "version")


@registered(f"""WITH {_MSG}, l AS (SELECT session_id, max(position) AS p FROM msg WHERE position % 5 = 0 GROUP BY 1)
SELECT msg.id FROM msg LEFT JOIN l USING (session_id) WHERE p IS NULL OR position > p""")
def message_since_summary(spark, d):
    """Summaries end at every fifth message of a session; what came after the last of them."""
    m = materialize(msgs(spark, d))
    s = m.where("position % 5 = 0").select("session_id", F.col("position").alias("version"), F.col("id").alias("message_range_end"))
    last = s.groupBy("session_id").agg(F.max("version").alias("version"))
    one = s.join(last, ["session_id", "version"]).groupBy("session_id", "version").agg(F.min("message_range_end").alias("message_range_end"))
    return M.since_summary(m, one).select("id")


# --- Checkpoints, plans, memory, suggestions ----------------------------------------------------


@registered("""WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id::VARCHAR AS session_id, event_id::VARCHAR AS id, step::INT AS step_number FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) <= 10""")
def checkpoint_save(spark, d):
    """Purchases and others saved as checkpoints in one go: numbered on, the latest ten of each user kept."""
    new = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("_k"))
    old = new.select("id", "session_id", F.lit(0).alias("step_number"), "created_at").limit(0)
    # ids are padded for the order of numbers
    saved = agents.save(old, new.select(F.col("_k").alias("id"), "session_id", "created_at"))
    return saved.select("session_id", F.regexp_replace("id", "^0+(?=.)", "").alias("id"), "step_number")


@registered("""SELECT user_id::VARCHAR AS session_id, arg_max(event_id, event_id)::VARCHAR AS id FROM events GROUP BY 1""")
def checkpoint_latest(spark, d):
    c = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("step_number"), F.col("ts").alias("created_at"))
    return agents.latest(c).select("session_id", "id")


@registered("""WITH RECURSIVE s AS (SELECT o_custkey AS plan_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status FROM orders),
x(plan_id, rn, id, status, doomed) AS (SELECT plan_id, rn, id, status, status = 'failed' FROM s WHERE rn = 1
  UNION ALL SELECT s.plan_id, s.rn, s.id, s.status, s.status = 'failed' OR (s.status = 'pending' AND x.doomed) FROM x JOIN s ON s.plan_id = x.plan_id AND s.rn = x.rn + 1)
SELECT plan_id, id, CASE WHEN status <> 'pending' THEN NULL WHEN doomed THEN 'skip' WHEN lag(status) OVER (PARTITION BY plan_id ORDER BY rn) <> 'done' THEN 'wait' ELSE 'run' END AS next FROM x""")
def plan_ready(spark, d):
    """A customer's orders as the steps of a plan, each depending on the one before."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.array_compact(F.array(before)).alias("dependencies"))
    return agents.ready(materialize(s)).select("plan_id", "id", "next")


@registered(f"""WITH {_MEMORY}, i AS (SELECT *, concat('note ', tier, ' ', access_count) AS content FROM mem),
r AS (SELECT session_id, id, tier, access_count, relevance_score, (contains(content, 'warm')::INT + contains(content, 'note')::INT) / 3.0::DOUBLE AS rel FROM i WHERE tier IN ('warm', 'cold'))
SELECT session_id, id, access_count + 1 AS access_count, round((relevance_score + rel) / 2, 6) AS relevance_score, tier FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, id) <= 3""")
def memory_recall(spark, d):
    i = memory(spark, d).withColumn("content", F.concat(F.lit("note "), "tier", F.lit(" "), F.col("access_count").cast("string")))
    q = i.select("session_id").distinct().select(F.col("session_id").alias("query_id"), "session_id", F.lit("warm note xx").alias("text"))
    return A.recall(i, q).select("session_id", "id", "access_count", r6("relevance_score").alias("relevance_score"), "tier")


@registered(f"WITH {_MEMORY} SELECT id, CASE WHEN tier = 'hot' AND access_count < 3 THEN 'cold' ELSE tier END AS tier FROM mem")
def memory_demote(spark, d):
    m = memory(spark, d)
    return E.set_columns(m, m.where("tier = 'hot' and access_count < 3"), {"tier": F.lit("cold")}).select("id", "tier")


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "shown", "purchase", "used", "error", "dismissed", "view", "pending")])
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), names[F.col("event_type")].alias("status"))


_SUG = "sug AS (SELECT event_id AS id, user_id AS session_id, MAP {'click': 'shown', 'purchase': 'used', 'error': 'dismissed', 'view': 'pending'}[event_type] AS status FROM events)"


@registered(f"""WITH {_SUG}, c AS (SELECT session_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'shown') AS shown,
  count(*) FILTER (status = 'used') AS used, count(*) FILTER (status = 'dismissed') AS dismissed FROM sug GROUP BY 1)
SELECT *, round(CASE WHEN shown + used + dismissed > 0 THEN used / (shown + used + dismissed) ELSE 0 END::DOUBLE, 6) AS use_rate FROM c""")
def suggestion_stats(spark, d):
    return A.suggestion_stats(_suggestions(spark, d)).withColumn("use_rate", r6("use_rate"))


@registered(f"WITH {_SUG} SELECT id, CASE WHEN status = 'pending' THEN 'shown' ELSE status END AS status FROM sug")
def suggestion_mark_shown(spark, d):
    s = _suggestions(spark, d)
    return E.set_columns(s, s.where("status = 'pending'"), {"status": F.lit("shown")}).select("id", "status")


@registered(f"""WITH {_ENT}, p AS (SELECT file_path AS q, id, type, 1.0 / (1 + coalesce(start_line, 0) % 3) AS score, updated_at FROM ent WHERE file_path IS NOT NULL),
k(kind, o, types, above, n) AS (VALUES ('decision', 0, ['decision'], 0.6, 5), ('change', 1, ['file', 'function', 'class'], 0.5, 3), ('doc', 2, ['document', 'section'], 0.65, 3), ('related_code', 3, ['function', 'class', 'method'], 0.5, 3)),
x AS (SELECT q, id, kind, o, score FROM p, k WHERE list_contains(types, type) AND score > above AND (kind <> 'change' OR updated_at IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, id) <= n),
one AS (SELECT q, id, arg_min(kind, o) AS kind, max(score) AS score FROM x GROUP BY 1, 2)
SELECT q AS query_id, id AS entity_id, kind, (row_number() OVER (PARTITION BY q ORDER BY score DESC, id))::INT AS rank FROM one WHERE score >= 0.5 QUALIFY rank <= 5""")
def proactive_suggestions(spark, d):
    """For each file the entities in it, scored by their lines."""
    score = 1.0 / (1 + F.coalesce("start_line", F.lit(0)) % 3)
    x = ents(spark, d).where("file_path is not null").select(F.col("file_path").alias("query_id"), F.col("id").alias("entity_id"), "type", score.alias("score"), "updated_at")
    return documents.suggestions(materialize(x)).select("query_id", "entity_id", "kind", "rank")


@registered("""WITH e AS (SELECT event_id, 'src/' || event_type || '/' || (user_id % 7) || '.ts' AS path, ts FROM events)
SELECT 'all' AS subscription_id, event_id FROM e WHERE regexp_matches(path, '^src/.*[.]ts$')
UNION ALL SELECT 'one', event_id FROM e WHERE path = 'src/click/3.ts' AND ts >= TIMESTAMPTZ '2024-01-10 00:00:05+00'""")
def subscriptions_due(spark, d):
    s = spark.sql("""SELECT * FROM VALUES ('all', array('src/**/*.ts'), 5000L, CAST(NULL AS TIMESTAMP), true), ('one', array('src/click/3.ts'), 5000L, TIMESTAMP '2024-01-10 00:00:00 UTC', true),
('off', array('**'), 5000L, NULL, false) AS t(id, patterns, cooldown_ms, last_triggered_at, enabled)""")
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("src/"), "event_type", F.lit("/"), (F.col("user_id") % 7).cast("string"), F.lit(".ts")).alias("path"), "ts")
    return documents.subscriptions_due(e, s)


# --- Results ------------------------------------------------------------------------------------


@registered(f"""WITH {_ENT}, s AS (SELECT file_path, count(*) FILTER (type IN ('function', 'method')) AS n_functions, count(*) FILTER (type = 'class') AS n_classes, count(*) AS n_symbols FROM ent GROUP BY 1)
SELECT *, CASE WHEN n_symbols <= 10 THEN 'low' WHEN n_symbols <= 20 THEN 'medium' ELSE 'high' END AS complexity FROM s""")
def file_metrics(spark, d):
    return A.file_metrics(ents(spark, d))


@registered("WITH s AS (SELECT l_suppkey AS report_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT report_id, CASE WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS risk FROM s")
def quick_risk(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("report_id")).agg(A.quick_risk(F.countDistinct("l_orderkey")).alias("risk"))


@registered(f"""WITH {_ENT}, {_EDGE}, {_DEC}, c AS (SELECT DISTINCT type AS r, file_path, CASE WHEN length(file_path) % 3 = 0 THEN 'D' ELSE 'M' END AS st FROM ent WHERE file_path IS NOT NULL),
f AS (SELECT r, count(*) FILTER (st = 'D') AS n_deleted, count(*) FILTER (st = 'M') AS n_modified FROM c GROUP BY 1),
h AS (SELECT r, st, id FROM c JOIN ent USING (file_path)), deg AS (SELECT target_id AS id, count(*) AS n FROM edge GROUP BY 1),
u AS (SELECT r, count(DISTINCT id) AS n_entities, count(DISTINCT id) FILTER (n > 5) AS n_widely_used FROM h LEFT JOIN deg USING (id) GROUP BY 1),
a AS (SELECT id AS dec, unnest(related_entity_ids) AS id FROM dec), b AS (SELECT r, count(DISTINCT dec) AS n_decisions, count(DISTINCT dec) FILTER (st = 'D') AS n_invalidated FROM h JOIN a USING (id) GROUP BY 1)
SELECT r AS report_id, n_deleted, n_modified, n_entities, n_widely_used, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_invalidated, 0) AS n_invalidated,
  2 * n_deleted + CASE WHEN n_modified > 10 THEN n_modified // 5 ELSE 0 END + 3 * n_widely_used + 2 * coalesce(n_invalidated, 0) AS risk_score FROM f LEFT JOIN u USING (r) LEFT JOIN b USING (r)""")
def impact_analysis(spark, d):
    """For each type of entity a change set of all files that hold one."""
    e = materialize(ents(spark, d).select("id", "type", "file_path"))
    st = F.when(F.length("file_path") % 3 == 0, "D").otherwise("M")
    c = e.where("file_path is not null").select(F.col("type").alias("report_id"), F.col("file_path").alias("path"), st.alias("status")).distinct()
    x = A.impact(c, e, edges(spark, d), _decisions(spark, d).select("id", F.col("related_entity_ids").alias("entity_ids")))
    return x.select("report_id", "n_deleted", "n_modified", "n_entities", "n_widely_used", "n_decisions", "n_invalidated", "risk_score")


@registered(f"""WITH {_MSG}, {_ENT}, p AS (SELECT id, content, lead(content) OVER w AS answer, lead(role) OVER w AS r, role FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS FIRST, position NULLS FIRST, id)),
q AS (SELECT id, answer FROM p WHERE role = 'user' AND r = 'assistant' AND answer IS NOT NULL), n AS (SELECT name, min(id) AS e FROM ent WHERE name IS NOT NULL AND type = 'class' GROUP BY 1)
SELECT id AS query_id, e AS entity_id, CASE WHEN contains(lower(answer), lower(name)) THEN 'used' ELSE 'ignored' END AS signal FROM q JOIN n ON md5(id)[1:2] = md5(e)[1:2]""")
def usage_detection(spark, d):
    """Answers against classes whose hash begins as theirs does: is the class named?"""
    q = M.pairs(msgs(spark, d)).where("answer is not null").select(F.col("id").alias("query_id"), F.col("answer").alias("response"))
    e = ents(spark, d).where("name is not null and type = 'class'").groupBy("name").agg(F.min("id").alias("id")).select("id", "name", F.lit(None).cast("string").alias("content"))
    q = materialize(q)
    r = q.select("query_id", F.substring(F.md5("query_id"), 1, 2).alias("_k")).join(e.select(F.col("id").alias("entity_id"), F.substring(F.md5("id"), 1, 2).alias("_k")), "_k").select("query_id", "entity_id")
    return A.used_in_response(r, q, e)


@registered(f"""WITH {_ENT}, c AS (SELECT file_path AS q, CASE WHEN type IN ('function', 'method', 'class', 'interface', 'type', 'file', 'module', 'variable', 'constant') THEN 'code'
  WHEN type IN ('document', 'section', 'requirement', 'feature', 'concept') THEN 'documentation' WHEN type IN ('session', 'message', 'decision', 'summary') THEN 'conversation' ELSE 'other' END AS cat, name FROM ent WHERE file_path IS NOT NULL),
n AS (SELECT q, cat, list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))) AS n FROM c GROUP BY 1, 2),
t AS (SELECT q, cat, cat || ': ' || array_to_string(n[1:3], ', ') || CASE WHEN len(n) > 3 THEN ' and ' || (len(n) - 3) || ' more' ELSE '' END AS t FROM n)
SELECT q AS query_id, string_agg(t, '; ' ORDER BY list_position(['code', 'documentation', 'conversation', 'other'], cat)) AS summary FROM t GROUP BY 1""")
def context_summary(spark, d):
    return context.summarize_names(ents(spark, d).where("file_path is not null").select(F.col("file_path").alias("query_id"), "type", "name"))


@registered(f"WITH {_ENT} SELECT id, round(1 - 0.01::DOUBLE * (row_number() OVER (PARTITION BY file_path ORDER BY id) - 1), 6) AS score FROM ent WHERE file_path IS NOT NULL")
def assemble_from_entities(spark, d):
    return context.from_entities(ents(spark, d).where("file_path is not null"), "file_path", [F.col("id")]).select("id", r6(F.col("score").cast("double")).alias("score"))


@registered(f"""WITH {_EDGE} SELECT source_id AS query_id, target_id AS entity_id, round(max(weight * CASE relationship WHEN 'USES' THEN 0.5 ELSE 1.0 END), 6) AS score FROM edge GROUP BY 1, 2""")
def merge_sub_queries(spark, d):
    """Edges as results of weighted sub-queries."""
    w = F.when(F.col("relationship") == "USES", 0.5).otherwise(1.0)
    x = edges(spark, d).select(F.col("source_id").alias("query_id"), F.col("target_id").alias("entity_id"), F.col("weight").alias("score"), w.alias("weight"))
    return fusion.merge_best(x).withColumn("score", r6("score"))


@registered(f"""WITH {_ENT}, r AS (SELECT file_path AS q, id, 1.0 / (1 + length(name)) AS s, length(name)::DOUBLE AS m, row_number() OVER (PARTITION BY file_path ORDER BY id) AS rank FROM ent WHERE file_path IS NOT NULL AND name IS NOT NULL),
t AS (SELECT *, max(m) FILTER (rank <= 3) OVER (PARTITION BY q) AS most FROM r)
SELECT q AS query_id, id AS entity_id, round(CASE WHEN rank <= 3 AND most > 0 THEN 0.7 * m / most + 0.3 * s ELSE s END::DOUBLE, 6) AS score FROM t""")
def model_rerank(spark, d):
    """Name lengths as the scores that a model gives."""
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("id"))
    x = ents(spark, d).where("file_path is not null and name is not null").select(F.col("file_path").alias("query_id"), F.col("id").alias("entity_id"), (1.0 / (1 + F.length("name"))).alias("score"), F.length("name").cast("double").alias("model_score"), rank.alias("rank"))
    return fusion.blend_model_scores(x, 3).select("query_id", "entity_id", r6("score").alias("score"))
