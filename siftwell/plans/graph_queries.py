"""Queries on the graph of entities and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import graph as G
from siftwell.operators import resolve, vectors
from siftwell.operators.components import components
from siftwell.plans.search_queries import _ENT, ents, r6
from siftwell.runtime import read

_EDGE = """edge AS (SELECT DISTINCT ON (id) id, source_id, target_id, relationship, coalesce(weight, 1.0) AS weight FROM relationships
  WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"""
def edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    return G.clean(read(spark, d, "relationships"), list(types) or None)


def _fiftieth(c):
    """The query set: ids whose hash is divisible by 50."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % 50 == 0


def starts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "entities").where(_fiftieth(F.col("id"))).select(F.col("id").alias("node")).distinct()


_STARTS = "starts AS (SELECT DISTINCT id AS node FROM entities WHERE ('0x' || substring(md5(id), 1, 8))::BIGINT % 50 = 0)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """From each start to the ends of a fiftieth of its edges, and to the entities whose hash begins as its own does (one in 4,096)."""
    s = starts(spark, d)
    r = edges(spark, d).select("source_id", "target_id")
    goals = r.where(_fiftieth(F.concat("source_id", F.lit("|"), "target_id")))
    near = goals.select(F.col("source_id").alias("start"), F.col("target_id").alias("goal")).join(s.select(F.col("node").alias("start")), "start", "left_semi")
    far = s.select(F.col("node").alias("start"), F.substring(F.md5("node"), 1, 3).alias("_k"))
    other = read(spark, d, "entities").select(F.col("id").alias("goal"), F.substring(F.md5(F.concat(F.lit("x"), "id")), 1, 3).alias("_k")).distinct()
    return near.unionByName(far.join(other, "_k").select("start", "goal")).where("start <> goal").distinct()


_PAIRS = f"""{_STARTS}, pairs AS (SELECT source_id AS start, target_id AS goal FROM edge WHERE ('0x' || substring(md5(source_id || '|' || target_id), 1, 8))::BIGINT % 50 = 0 AND source_id IN (FROM starts) AND source_id <> target_id
  UNION SELECT node, id FROM starts JOIN (SELECT DISTINCT id FROM entities) g ON substring(md5(node), 1, 3) = substring(md5('x' || id), 1, 3) WHERE node <> id)"""


def graph_degree_topn(spark, d):
    return G.most_connected(edges(spark, d), 20).select("node", "degree")


def graph_degrees(spark, d):
    return G.degrees(edges(spark, d)).select("node", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), "degree")


def graph_avg_degree(spark, d):
    return G.average_degree(edges(spark, d)).select("n_edges", "n_nodes", r6("average_degree").alias("average_degree"))


def edge_type_stats(spark, d):
    return G.edge_counts(edges(spark, d))


def or_join_degree(spark, d):
    return G.touching(edges(spark, d))


def graph_roots_leaves(spark, d):
    return G.roots_and_leaves(edges(spark, d))


def graph_bfs_2hop(spark, d):
    return G.distances(edges(spark, d), starts(spark, d), "both", 2).select("start", "node", "depth")


def graph_neighbourhood_edges(spark, d):
    return G.neighbourhood(edges(spark, d), starts(spark, d), 1)[1]


def graph_reachable(spark, d):
    return G.reached(edges(spark, d, "IMPORTS", "CONTAINS", "USES"), starts(spark, d))


def graph_dependents(spark, d):
    return G.dependents(edges(spark, d), starts(spark, d)).select("start", "node")


def graph_shortest_path(spark, d):
    return G.shortest_path(edges(spark, d), pairs(spark, d)).select("start", "goal", "length")


def graph_simple_paths(spark, d):
    return G.simple_paths(edges(spark, d), pairs(spark, d), 4, 10).select("start", "goal", "length", "rank")


def graph_connected(spark, d):
    return G.connected(edges(spark, d), pairs(spark, d), 3)


def graph_components(spark, d):
    return components(edges(spark, d, "EXTENDS", "IMPLEMENTS", "DEPENDS_ON"), "source_id", "target_id")


def common_neighbors(spark, d):
    return G.common_neighbours(edges(spark, d), pairs(spark, d))


def type_subgraph(spark, d):
    return G.of_types(edges(spark, d), read(spark, d, "entities"), ["class", "interface", "type"]).select("id")


def orphan_edges(spark, d):
    return G.orphan_edges(edges(spark, d), read(spark, d, "entities")).select("id")


def edge_names(spark, d):
    """Edges with the names and types of both ends."""
    e = ents(spark, d)
    s = e.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    t = e.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges(spark, d).join(s, "source_id").join(t, "target_id").select("id", "source_name", "target_name", "relationship")


def union_distinct_nodes(spark, d):
    e = edges(spark, d)
    return e.select(F.col("source_id").alias("node")).union(e.select(F.col("target_id"))).distinct()


def _similar(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    x = e.select(F.col("vec_id").cast("string").alias("entity_id"), "embedding")
    q = e.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.knn(x, q, 6, 0.3).where("query_id <> entity_id").select(F.col("query_id").alias("entity_id"), F.col("entity_id").alias("other"), "score")


_SIM = """e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings),
sim AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= 6),
near AS (SELECT * FROM sim WHERE a <> b AND score >= 0.3)"""


def semantic_links(spark, d):
    return resolve.semantic_links(_similar(spark, d), edges(spark, d), threshold=0.4).select("source_id", "target_id", r6("weight").alias("weight"))


def duplicate_groups(spark, d):
    e = read(spark, d, "embeddings")
    return resolve.vector_groups(e.select(F.col("vec_id").cast("string").alias("entity_id"), "embedding"), 0.4)


def reference_resolution(spark, d):
    """Names and paths that entities' summaries mention in CamelCase, resolved to entities."""
    e = ents(spark, d)
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit("([A-Z][a-z]+(?:[A-Z][a-z]+)+)"), F.lit(1))))
    refs = e.select("id", found.alias("text")).select(F.concat_ws("|", "id", "text").alias("ref_id"), "text")
    return resolve.references(refs, e)


QUERIES = {
    f.__name__: f
    for f in (
        graph_degree_topn, graph_degrees, graph_avg_degree, edge_type_stats, or_join_degree, graph_roots_leaves, graph_bfs_2hop,
        graph_neighbourhood_edges, graph_reachable, graph_dependents, graph_shortest_path, graph_simple_paths, graph_connected,
        graph_components, common_neighbors, type_subgraph, orphan_edges, edge_names, union_distinct_nodes, semantic_links,
        duplicate_groups, reference_resolution,
    )
}
_BOTH = "ways AS (SELECT source_id AS a, target_id AS b FROM edge UNION ALL SELECT target_id, source_id FROM edge)"
_DEG = "deg AS (SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS degree FROM (SELECT source_id AS node, 0 AS i, 1 AS o FROM edge UNION ALL SELECT target_id, 1, 0 FROM edge) GROUP BY 1)"
SQL = {
    "graph_degree_topn": f"WITH {_EDGE}, {_DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 20",
    "graph_degrees": f"WITH {_EDGE}, {_DEG} SELECT * FROM deg",
    "graph_avg_degree": f"WITH {_EDGE}, {_DEG} SELECT (SELECT count(*) FROM edge) AS n_edges, count(*) AS n_nodes, round(2 * (SELECT count(*) FROM edge) / count(*), 6) AS average_degree FROM deg",
    "edge_type_stats": f"WITH {_EDGE} SELECT relationship, count(*) AS n_edges FROM edge GROUP BY 1",
    "or_join_degree": f"WITH {_EDGE} SELECT node, count(*) AS n_edges FROM (SELECT source_id AS node FROM edge UNION ALL SELECT target_id FROM edge WHERE target_id <> source_id) GROUP BY 1",
    "graph_roots_leaves": f"""WITH {_EDGE}, {_DEG} SELECT node, 'root' AS role FROM deg WHERE n_in = 0 UNION ALL SELECT node, 'leaf' FROM deg WHERE n_out = 0
UNION ALL (SELECT node, 'hub' FROM deg ORDER BY degree DESC, node LIMIT 10)""",
    "graph_bfs_2hop": f"""WITH {_EDGE}, {_STARTS}, {_BOTH}, d AS (SELECT node AS start, node, 0 AS depth FROM starts
  UNION ALL SELECT s.node, w.b, 1 FROM starts s JOIN ways w ON w.a = s.node UNION ALL SELECT s.node, y.b, 2 FROM starts s JOIN ways x ON x.a = s.node JOIN ways y ON y.a = x.b)
SELECT start, node, min(depth)::INT AS depth FROM d GROUP BY 1, 2""",
    "graph_neighbourhood_edges": f"WITH {_EDGE}, {_STARTS} SELECT DISTINCT node AS start, id FROM starts JOIN edge ON node = source_id OR node = target_id",
    "graph_reachable": f"""WITH RECURSIVE {_EDGE}, {_STARTS}, r(start, node) AS (SELECT node, node FROM starts
  UNION SELECT start, target_id FROM r JOIN edge ON source_id = r.node AND relationship IN ('IMPORTS', 'CONTAINS', 'USES'))
SELECT start, node FROM r WHERE start <> node""",
    "graph_dependents": f"WITH {_EDGE}, {_STARTS} SELECT DISTINCT node AS start, source_id AS node FROM starts JOIN edge ON target_id = node WHERE source_id <> starts.node",
    "graph_shortest_path": f"""WITH RECURSIVE {_EDGE}, {_PAIRS}, one AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edge),
r(start, node, depth) USING KEY (start, node) AS (SELECT DISTINCT start, start, 0 FROM pairs
  UNION SELECT r.start, b, r.depth + 1 FROM r JOIN one ON a = r.node LEFT JOIN recurring.r AS x ON x.start = r.start AND x.node = b WHERE x.node IS NULL)
SELECT p.start, p.goal, depth::INT AS length FROM pairs p JOIN r ON r.start = p.start AND r.node = p.goal""",
    "graph_simple_paths": f"""WITH RECURSIVE {_EDGE}, {_PAIRS}, p(start, node, path, n) AS (SELECT DISTINCT start, start, [start], 0 FROM pairs
  UNION ALL SELECT start, target_id, list_append(path, target_id), n + 1 FROM p JOIN edge ON source_id = node WHERE n < 4 AND NOT list_contains(path, target_id)),
hit AS (SELECT p.start, goal, n FROM p JOIN pairs ON p.start = pairs.start AND node = goal)
SELECT start, goal, n::INT AS length, (row_number() OVER (PARTITION BY start, goal ORDER BY n))::INT AS rank FROM hit QUALIFY rank <= 10""",
    "graph_connected": f"""WITH RECURSIVE {_EDGE}, {_PAIRS}, two AS (SELECT start AS a, goal AS b FROM pairs UNION SELECT goal, start FROM pairs),
r(start, node, n) AS (SELECT DISTINCT a, a, 0 FROM two UNION SELECT start, target_id, n + 1 FROM r JOIN edge ON source_id = node WHERE n < 3)
SELECT start, goal, EXISTS (SELECT 1 FROM r WHERE (r.start = pairs.start AND r.node = pairs.goal) OR (r.start = pairs.goal AND r.node = pairs.start)) AS connected FROM pairs""",
    "graph_components": f"""WITH RECURSIVE {_EDGE}, w AS (SELECT source_id AS a, target_id AS b FROM edge WHERE relationship IN ('EXTENDS', 'IMPLEMENTS', 'DEPENDS_ON') AND source_id <> target_id),
two AS (SELECT a, b FROM w UNION SELECT b, a FROM w),
r(node, m) USING KEY (node) AS (SELECT a, min(b) FROM (SELECT a, b FROM two UNION SELECT a, a FROM two) GROUP BY a
  UNION SELECT two.b, min(r.m) FROM r JOIN two ON two.a = r.node JOIN recurring.r AS o ON o.node = two.b WHERE r.m < o.m GROUP BY two.b)
SELECT node, m AS component FROM r""",
    "common_neighbors": f"""WITH {_EDGE}, {_PAIRS}, {_BOTH} SELECT DISTINCT start, goal, x.b AS node FROM pairs JOIN ways x ON x.a = start JOIN ways y ON y.a = goal AND y.b = x.b
WHERE x.b <> start AND x.b <> goal""",
    "type_subgraph": f"WITH {_EDGE}, t AS (SELECT id FROM entities WHERE type IN ('class', 'interface', 'type')) SELECT id FROM edge WHERE source_id IN (FROM t) AND target_id IN (FROM t)",
    "orphan_edges": f"WITH {_EDGE} SELECT id FROM edge WHERE source_id NOT IN (SELECT id FROM entities) OR target_id NOT IN (SELECT id FROM entities)",
    "edge_names": f"WITH {_ENT}, {_EDGE} SELECT edge.id, s.name AS source_name, t.name AS target_name, relationship FROM edge JOIN ent s ON s.id = source_id JOIN ent t ON t.id = target_id",
    "union_distinct_nodes": f"WITH {_EDGE} SELECT source_id AS node FROM edge UNION SELECT target_id FROM edge",
    "semantic_links": f"""WITH {_EDGE}, {_SIM} SELECT least(a, b) AS source_id, greatest(a, b) AS target_id, round(max(score), 6) AS weight FROM near WHERE score >= 0.4
  AND NOT EXISTS (SELECT 1 FROM edge WHERE (source_id = a AND target_id = b) OR (source_id = b AND target_id = a)) GROUP BY 1, 2""",
    "duplicate_groups": """WITH RECURSIVE e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM e),
nb AS (SELECT a.id AS lo, b.id AS hi FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4), own AS (SELECT k, id, coalesce(list(hi) FILTER (hi IS NOT NULL), []) AS l FROM ids LEFT JOIN nb ON lo = id GROUP BY 1, 2),
r(k, taken) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT own.k, CASE WHEN list_contains(taken, id) THEN taken ELSE list_concat(taken, l) END FROM r JOIN own ON own.k = r.k + 1),
t AS (SELECT unnest(list_distinct(taken)) AS id FROM r WHERE k = (SELECT max(k) FROM ids)), led AS (SELECT hi AS id, min(lo) AS primary_id FROM nb WHERE hi IN (FROM t) AND lo NOT IN (FROM t) GROUP BY 1)
FROM led UNION SELECT primary_id, primary_id FROM led""",
    "reference_resolution": f"""WITH {_ENT}, refs AS (SELECT DISTINCT concat_ws('|', id, t) AS ref_id, t FROM (SELECT id, unnest(regexp_extract_all(coalesce(summary, ''), '([A-Z][a-z]+(?:[A-Z][a-z]+)+)', 1)) AS t FROM ent)),
hits AS (SELECT ref_id, id, 1 AS tier FROM refs JOIN ent ON qualified_name = t UNION ALL SELECT ref_id, id, 2 FROM refs JOIN ent ON file_path = t AND type = 'file'
  UNION ALL SELECT ref_id, id, CASE WHEN type IN ('class', 'interface', 'type') THEN 3 WHEN type IN ('function', 'method') THEN 4 ELSE 5 END FROM refs JOIN ent ON name = t)
SELECT ref_id, arg_min(id, (tier, id)) AS entity_id, min(tier)::INT AS tier FROM hits GROUP BY 1""",
}
