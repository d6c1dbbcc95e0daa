import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.operators import graph as G
from siftwell.operators import search
from siftwell.operators.index import Index
from siftwell.plans import graph_queries


def random_graph(spark, nodes=40, ways=110, seed=3):
    rng = random.Random(seed)
    data = [(f"e{i:03}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", "uses", rng.choice([0.5, 1.0, 2.0, None])) for i in range(ways)]
    data += [("z1", None, "n1", "uses", 1.0), ("z2", "n1", None, "uses", 1.0), data[0]]
    return G.clean(spark.createDataFrame(data, "id string, source_id string, target_id string, relationship string, weight double"))


@pytest.mark.parametrize("direction,depth", [("out", None), ("in", 2), ("both", 3)])
def test_small_and_large_graphs_are_walked_alike(spark, rows, monkeypatch, direction, depth):
    edges = random_graph(spark)
    starts = spark.createDataFrame([("n1",), ("n2",), ("n1",), (None,), ("nowhere",)], "node string")
    small = rows(G.distances(edges, starts, direction, depth), "start", "node", "depth")
    monkeypatch.setattr(G, "SMALL", 0)
    assert rows(G.distances(edges, starts, direction, depth), "start", "node", "depth") == small
    assert ("nowhere", "nowhere", 0) in small and len(small) > 10


def test_paths_of_small_and_large_graphs(spark, rows, monkeypatch):
    edges = random_graph(spark, seed=5)
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(6) for j in range(8)] + [("n1", None), ("n0", "nowhere")], "start string, goal string")
    small = rows(G.shortest_path(edges, pairs), "start", "goal", "path", "length")
    monkeypatch.setattr(G, "SMALL", 0)
    assert rows(G.shortest_path(edges, pairs), "start", "goal", "path", "length") == small
    assert len(small) > 20 and ("n1", "n1", ["n1"], 0) in small


def test_simple_paths_stop_once_a_pair_has_enough(spark, rows):
    data = [("a", "s", "g", "uses", 1.0)] + [(f"x{i}", "s", f"m{i}", "uses", 1.0) for i in range(5)] + [(f"y{i}", f"m{i}", "g", "uses", float(i)) for i in range(5)]
    edges = spark.createDataFrame(data, "id string, source_id string, target_id string, relationship string, weight double")
    pairs = spark.createDataFrame([("s", "g")], "start string, goal string")
    assert rows(G.simple_paths(edges, pairs, 5, 1), "length", "rank") == [(1, 1)]
    assert [r[1] for r in rows(G.simple_paths(edges, pairs, 5, 3), "rank", "edges")] == [["a"], ["x4", "y4"], ["x3", "y3"]]


def docs(spark, data):
    return spark.createDataFrame(data, "id string, text string, bucket int")


def test_a_kept_index_equals_a_scan_after_changes(spark, rows, tmp_path):
    q = spark.createDataFrame([(1, "cat"), (2, "bird dog"), (3, "")], "query_id int, text string")
    first = [("a", "cats and dogs", 1), ("b", "a bird", 2), ("c", None, 3), ("d", "dog dog bird", 4)]
    index = Index(spark, str(tmp_path / "index"))
    index.build(docs(spark, first), "id", "text")

    def scanned(data):
        return rows(search.bm25_scan(docs(spark, data), "id", ["text"], q))

    assert rows(index.search(q)) == scanned(first)
    old = index.version()
    index.update(docs(spark, [("b", "a catalogue", 2), ("e", "dog", 5)]), docs(spark, [("d", None, 0)]), "id", "text")
    assert index.version() != old
    after = [("a", "cats and dogs", 1), ("b", "a catalogue", 2), ("c", None, 3), ("e", "dog", 5)]
    assert rows(index.search(q)) == scanned(after)


def test_more_patterns_than_one_scan_takes(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "SUBSTRINGS", 2)
    df = docs(spark, [("a", "alpha Beta", 1), ("b", "gamma", 2), ("c", None, 3)])
    got = rows(search.substrings(df, "id", ["text"], {1: "ALPHA", 2: "beta", 3: "amm", 4: "zz", 5: "a"}))
    assert got == [(1, "a"), (2, "a"), (3, "b"), (5, "a"), (5, "b")]
    assert rows(search.substrings(df, "id", ["text"], {})) == []


def ways_of(pairs):
    """A graph of numbered nodes, its ways in the order given."""
    a, b = np.array(sorted(pairs, key=lambda p: p[0])).T
    return G.Ways(pa.array([f"n{i:02}" for i in range(int(max(a.max(), b.max())) + 1)]), a, b)


@pytest.mark.parametrize("piece", [1, 3, 1 << 18])
def test_levels_do_not_depend_on_how_a_hop_is_cut(monkeypatch, piece):
    monkeypatch.setattr(G, "PIECE", piece)
    g = ways_of([(0, 3), (0, 1), (0, 3), (3, 2), (1, 2), (1, 4), (2, 0), (4, 5), (3, 5)])
    assert [(hop, nodes.tolist(), by.tolist()) for hop, nodes, by in g.levels(0)] == [(1, [3, 1], [0, 0]), (2, [2, 5, 4], [3, 3, 1])]
    assert len(list(g.levels(0, 1))) == 1 and list(g.levels(5)) == []


def test_ways_of_a_gigabyte_are_walked_in_one_pass(spark, rows, monkeypatch):
    """A gigabyte of tables has some 4.4 million ways walked both ways; joins hop by hop took more than the time and the disk there are."""
    monkeypatch.setattr(G, "_hops", None)
    n = 2_200_000
    hub = F.when(F.col("id") % 10 == 0, F.lit("hub")).otherwise(F.concat(F.lit("t"), F.col("id") % 1000))
    edges = spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), (F.col("id") / 5).cast("long")).alias("source_id"), hub.alias("target_id"), F.lit(None).cast("double").alias("weight"))
    starts = spark.createDataFrame([("s0",), ("s1",), ("gone",)], "node string")
    got = G.distances(edges, starts, "both", 2).groupBy("start", "depth").count()
    # s0 leads to the hub and to t1 to t4, s1 to t5 to t9; the hub is reached by 220,000 sources, each t by 2,200 others
    assert rows(got) == [("gone", 0, 1), ("s0", 0, 1), ("s0", 1, 5), ("s0", 2, 219_999), ("s1", 0, 1), ("s1", 1, 5), ("s1", 2, 2_199)]


def test_far_nodes_of_over_a_million_ways_are_reached_in_one_pass(spark, rows, monkeypatch):
    """Of a gigabyte's relationships 1.02 million are of the types walked; hop by hop, all that was met lay on disk several times."""
    monkeypatch.setattr(G, "_hops", None)
    i = F.col("id")
    ends = [F.concat(F.lit("c"), F.least(i, F.lit(50))).alias("source_id"), F.when(i < 50, F.concat(F.lit("c"), i + 1)).otherwise(F.concat(F.lit("t"), i)).alias("target_id")]
    edges = spark.range(1_100_000).select(i.cast("string").alias("id"), *ends, F.lit(1.0).alias("weight"))
    got = G.reachable(edges, spark.createDataFrame([("c0",), ("c49",), ("t60",)], "node string"))
    assert rows(got.groupBy("start").agg(F.count("*"), F.countDistinct("node"), F.max("depth"))) == [("c0", 1_100_000, 1_100_000, 51), ("c49", 1_099_951, 1_099_951, 2)]


def test_stored_rows_of_nodes_that_all_starts_reach_are_small(spark, tmp_path, monkeypatch):
    """Stored, the rows of a gigabyte filled the disk: an id of 16 characters in each, as no dictionary holds all nodes."""
    n, name = 60_000, lambda c: F.substring(F.md5(c.cast("string")), 1, 16)
    i = F.col("id")
    ways = spark.range(2 * n).select(i.cast("string").alias("id"), name((i / 2).cast("long")).alias("source_id"), name(i % n).alias("target_id"), F.lit("USES").alias("relationship"), F.lit(1.0).alias("weight"))
    ways.write.parquet(str(tmp_path / "relationships.parquet"))
    monkeypatch.setattr(graph_queries, "starts", lambda spark, d: spark.range(50).select(F.when(i < 40, name(i * 31)).otherwise(F.concat(F.lit("gone"), i)).alias("node")))
    graph_queries.graph_reachable(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    each = got.groupBy("start").agg(F.count("*").alias("n"), F.countDistinct("node").alias("k"), F.max(F.expr("start = node")).alias("own")).collect()
    assert len(each) == 40 and {(r.n, r.k, r.own) for r in each} == {(n - 1, n - 1, False)}
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * got.count()


@pytest.mark.parametrize("sets,turn,least", [(1, 2, 1), (16, 256, 1 << 21)])
def test_nodes_reached_by_shared_sets_are_those_reached_by_each_start(spark, rows, monkeypatch, sets, turn, least):
    data = [(f"e{i}", f"{part}{a % 30}", f"{part}{b % 30}", "uses", 1.0) for part in "xy" for i, (a, b) in enumerate([(k, k * k + 1) for k in range(30)] + [(3, 3), (5, 4), (9, 5)])]
    edges = spark.createDataFrame([(f"{d[1]}{d[0]}", *d[1:]) for d in data], "id string, source_id string, target_id string, relationship string, weight double")
    starts = spark.createDataFrame([(f"{part}{k}",) for part in "xyz" for k in range(30)] + [("x3",), (None,)], "node string")
    for k, v in {"SETS": sets, "TURN": turn, "WIDTH": 4, "ROWS": (least, 1 << 24)}.items():
        monkeypatch.setattr(G, k, v)
    for direction in ("out", "both"):
        want = rows(G.reachable(edges, starts, direction), "start", "node")
        assert rows(G.reached(edges, starts, direction), "start", "node") == want and len(want) > 100
    monkeypatch.setattr(G, "SMALL", 0)
    assert rows(G.reached(edges, starts, "both"), "start", "node") == want
    none = edges.where("id = ''")
    assert rows(G.reached(none, starts)) == []


@pytest.mark.parametrize("size", [1, 7, 100])
def test_goals_of_a_start_share_one_search(monkeypatch, size):
    g, searches = ways_of([(i, i + 1) for i in range(99)] + [(0, 50)]), []
    levels = g.levels
    monkeypatch.setattr(g, "levels", lambda start: searches.append(start) or levels(start))
    monkeypatch.setattr(G, "_gathered", lambda batches: map(pa.Table.from_batches, ([b] for b in batches)))
    pairs = pa.table({"start": ["n00"] * 100 + ["n98"] * 3 + ["gone"] * 2, "goal": [f"n{i:02}" for i in range(100)] + ["n99", "n00", "gone"] + ["n00", "gone"]})
    got = [r for b in G.paths(g, pairs.to_batches(size)) for r in b.to_pylist()]
    assert searches == [0, 98]
    assert {r["goal"]: len(r["path"]) - 1 for r in got if r["start"] == "n00"} == {f"n{i:02}": i if i < 50 else i - 49 for i in range(100)}
    assert [r["path"] for r in got if r["goal"] == "n52"] == [["n00", "n50", "n51", "n52"]]
    assert sorted((r["start"], r["path"]) for r in got if r["start"] != "n00") == [("gone", ["gone"]), ("n98", ["n98", "n99"])]


def test_paths_of_over_a_million_ways_in_one_pass(spark, rows, monkeypatch):
    """All of a gigabyte's 2.4 million relationships are walked; the rows met, hop by hop, filled the disk."""
    monkeypatch.setattr(G, "_path_hops", None)
    i = F.col("id")
    ends = [F.concat(F.lit("c"), F.least(i, F.lit(50))).alias("source_id"), F.when(i < 50, F.concat(F.lit("c"), i + 1)).otherwise(F.concat(F.lit("t"), i)).alias("target_id")]
    edges = spark.range(1_100_000).select(i.cast("string").alias("id"), *ends, F.lit(1.0).alias("weight"))
    pairs = spark.createDataFrame([("c0", "t1000000"), ("c0", "c9"), ("c49", "t77"), ("t77", "c0"), ("c49", "c0")], "start string, goal string")
    got = G.shortest_path(edges, pairs)
    assert rows(got, "start", "goal", "length") == [("c0", "c9", 9), ("c0", "t1000000", 51), ("c49", "t77", 2)]
    assert rows(got.where("start = 'c49'"), "path") == [(["c49", "c50", "t77"],)]
