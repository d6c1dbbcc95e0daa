import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import analytics, changes, chunks, context, documents, entities, fusion, graph, joins, messages, resolve, search, vectors
from siftwell.operators.components import components
from siftwell.plans import analytics_queries, graph_queries, search_queries

T = [dt.datetime(2024, 1, i + 1) for i in range(20)]


def ent(spark, data):
    """id, type, name, content, summary, file_path, line, metadata."""
    rows = [(i, t, n, f"{f}::{n}" if f else None, c, s, m, f, ln, ln, None, T[0], T[0]) for i, t, n, c, s, f, ln, m in data]
    return spark.createDataFrame(rows, schemas.ENTITIES)


@pytest.fixture
def five(spark):
    return ent(
        spark,
        [
            ("1", "function", "login", "checks the password of a user " * 3, "logs in", "src/auth.ts", 1, {}),
            ("2", "function", "logout", "ends the session", None, "src/auth.ts", 20, {}),
            ("3", "class", "UserStore", "stores users in the database", "store of users", "src/store.ts", 1, {"connectionCount": "9"}),
            ("4", "file", "auth.ts", "", None, "src/auth.ts", None, {}),
            ("5", "instruction", "style", "use tabs " * 20, None, None, None, {"active": "false", "tags": "style, team"}),
        ],
    )


def edge(spark, data):
    return spark.createDataFrame([(f"e{i}", s, t, r, w, {}, T[0]) for i, (s, t, r, w) in enumerate(data)], schemas.RELATIONSHIPS)


def batch(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_upsert_update_delete(spark, rows, five):
    new = ent(spark, [("9", "function", "login", "new", None, "src/auth.ts", 2, {"k": "v"}), ("10", "class", "New", "x", None, "n.ts", 1, {})])
    up = entities.upsert(five, new, ["qualified_name"])
    assert up.count() == 6
    assert rows(up.where("name = 'login'"), "id", "content", "start_line") == [("1", "new", 2)]
    changed = entities.update(five, spark.createDataFrame([("3", "text", {"a": "b"})], "id string, content string, metadata map<string,string>"))
    r = changed.where("id = '3'").first()
    assert r.content == "text" and r.metadata == {"connectionCount": "9", "a": "b"} and len(r.hash) == 16
    gone = spark.createDataFrame([("1",)], "id string")
    assert rows(entities.set_columns(five, gone, {"summary": F.lit("set")}).where("summary = 'set'"), "id") == [("1",)]
    assert rows(entities.symbols(five, "USERSTORE"), "id") == [("3",)]
    e, g, v = entities.delete_cascade(five, edge(spark, [("1", "2", "CALLS", 1.0), ("2", "3", "USES", 1.0), ("3", "1", "USES", 1.0)]), spark.createDataFrame([("1", "m", 0, None, [1.0], None)], schemas.VECTORS), gone)
    assert (e.count(), g.count(), v.count()) == (4, 1, 0)


def test_entity_scans(spark, rows, five):
    assert rows(entities.by_name(five, "login"), "id") == [("1",)]
    assert [r.id for r in entities.by_file(five, "src/auth.ts").collect()] == ["4", "1", "2"]
    assert [r.id for r in entities.page(five, 2, 1).collect()] == ["4", "1"]
    assert [r.id for r in entities.page_after(five, "2", 2).collect()] == ["3", "4"]
    assert rows(entities.instructions(five, active_only=False, tag="team"), "id") == [("5",)]
    assert entities.instructions(five).count() == 0
    assert schemas.invalid(five, schemas.ENTITIES) == []


def test_store_vectors(spark, rows):
    old = spark.createDataFrame([("a", "m", i, "h", [1.0], None) for i in range(3)] + [("b", "m", 0, "h", [1.0], None)], schemas.VECTORS)
    new = spark.createDataFrame([("a", "m", 0, "n", [2.0], None)], schemas.VECTORS)
    assert rows(entities.store_vectors(old, new), "entity_id", "chunk_index", "content_hash") == [("a", 0, "n"), ("b", 0, "h")]
    assert entities.store_vectors(old, new.withColumn("chunk_index", F.lit(2))).count() == 4


def test_tiers(spark, five):
    hits = search.tiered(five, batch(spark, "LOGIN", "auth.ts::logout", "users database", "asswor", "nothinghere", ""), 10).collect()
    got = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault(h.query_id, []).append((h.doc, h.tier))
    assert got[0][0] == ("1", 1)
    assert got[2][0] == ("3", 3)
    assert got[3] == [("1", 4)]
    assert 4 not in got and 5 not in got
    assert all(a["score"] >= b["score"] for a in hits for b in hits if a.query_id == b.query_id and a.tier < b.tier)


def test_bm25_orders_by_relevance(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "cat dog dog bird fish tree"), (3, "bird"), (4, None), (5, "")], "id int, t string")
    r = {x.doc: x.score for x in search.bm25(search.postings(docs, "id", "t"), search.stats(docs, "t"), batch(spark, "cat"), prefix=False).collect()}
    assert set(r) == {1, 2} and r[1] > r[2] > 0
    both = search.bm25(search.postings(docs, "id", "t"), search.stats(docs, "t"), batch(spark, "bird dog"), all_terms=True).collect()
    assert [x.doc for x in both] == [2]


def test_knn(spark, rows):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    v = spark.createDataFrame([(f"e{i // 2}", "m", i % 2, None, r.tolist(), None) for i, r in enumerate(x)] + [("z", "m", 0, None, [0.0] * 8, None), ("n", "m", 0, None, None, None)], schemas.VECTORS)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "query_id int, vector array<double>")
    got = {}
    for r in vectors.knn(v, q, 5).collect():
        got.setdefault(r.query_id, {})[r.entity_id] = r["rank"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(4):
        best = {}
        for j, s in enumerate(u @ u[i]):
            best[f"e{j // 2}"] = max(best.get(f"e{j // 2}", -9), s)
        want = sorted(best, key=lambda e: -best[e])[:5]
        assert sorted(got[i], key=got[i].get) == want
    a = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r.c for r in a.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0, 0, pytest.approx(1)]


def test_knn_of_more_queries_than_are_broadcast(spark, rows, monkeypatch):
    x = np.random.default_rng(2).standard_normal((90, 8)).tolist()
    v = spark.createDataFrame([(f"e{i // 2}", r) for i, r in enumerate(x)] + [("e0", x[0]), ("z", [0.0] * 8), ("n", None)], "entity_id string, embedding array<double>")
    q = spark.createDataFrame([(i, r) for i, r in enumerate(x)] + [(90, None), (91, [1.0])], "query_id int, vector array<double>")
    cols = "query_id", "entity_id", F.round("score", 9), "rank"
    want = rows(vectors.knn(v, q, 5), *cols)
    monkeypatch.setattr(vectors, "QUERIES", 20)
    monkeypatch.setattr(vectors, "BLOCK", 16, raising=False)
    assert len(want) == 450
    assert rows(vectors.knn(v, q, 5), *cols) == want


def test_knn_queries_are_a_fiftieth_of_the_ids(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((160, 8)).tolist()
    spark.createDataFrame([(i, r, i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for f in (search_queries.knn_topk, search_queries.knn_best_chunk_dedup, search_queries.knn_type_filter):
        assert {r.query_id for r in f(spark, str(tmp_path)).collect()} == {0, 50, 100, 150}


def test_fusion_rerank_confidence(spark, five):
    res = spark.createDataFrame([(0, "1", 0.9, "keyword"), (0, "2", 0.8, "keyword"), (0, "1", 0.1, "keyword"), (0, "3", 0.9, "semantic"), (0, "1", 0.5, "semantic")], "query_id int, entity_id string, score double, source string")
    r = {x.entity_id: x for x in fusion.rrf(res).collect()}
    assert r["1"].score == pytest.approx(0.6 / 61 + 0.6 / 63 + 1 / 62) and r["1"].source == "keyword"
    top = fusion.rerank(fusion.rrf(res), batch(spark, "login"), five).orderBy("rank").collect()
    assert top[0].entity_id == "1" and top[0].score == 1
    c = spark.createDataFrame([(0, f"{i}", s) for i, s in enumerate((1.0, 0.5, 0.0))], "query_id int, entity_id string, score double")
    assert fusion.confidence(c).first().confidence == pytest.approx((1 + 0.35) / (1 + 0.7 + 0.49))


def test_assembly_keeps_the_budget(spark, five):
    res = spark.createDataFrame([(0, "1", 1.0), (0, "3", 0.9), (0, "2", 0.8), (0, "4", 0.7), (0, "5", 0.05)], "query_id int, entity_id string, score double")
    full = context.assemble(res, five).first()
    assert full.sources == ["1", "3", "2"] and not full.truncated and "auth.ts (file)" not in full.context
    tight = context.assemble(res, five, max_tokens=260).first()
    assert tight.truncated and tight.sources == ["1"]
    for style in ("xml", "plain"):
        assert "login" in context.assemble(res, five, style=style).first().context


def test_greedy_skips_what_does_not_fit(spark, rows):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((50, 60, 30, 20, 10))], "q int, o int, tokens int")
    assert rows(context.greedy(df, "q", ["o"], "tokens", 100, ["o"]), "o") == [(0,), (2,), (3,)]
    assert rows(context.prefix(df, "q", [F.col("o")], "tokens", 100), "o") == [(0,)]


def test_expansion(spark, five, rows):
    g = edge(spark, [("4", "1", "CONTAINS", 1.0), ("1", "3", "USES", None), ("1", "2", "USES", 1.0), ("4", "5", "IMPORTS", 1.0)])
    res = spark.createDataFrame([(0, "1", 1.0)], "query_id int, entity_id string, score double")
    got = rows(context.expand(res, g, five), "entity_id", "score", "reason")
    assert got == sorted([("1", 1.0, None), ("3", 0.3, "type"), ("4", 0.5, "parent")], key=str)
    assert context.expand(res, g, five, budget=0).count() == 2  # the file has no text and fits


def reach(data, start, n=99):
    seen, front = {start: 0}, [start]
    for d in range(1, n + 1):
        front = list({t for s, t, *_ in data if s in front and t not in seen})
        seen.update(dict.fromkeys(front, d))
    return seen


def test_graph_against_plain_search(spark, rows):
    rng = random.Random(2)
    data = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", "CALLS", rng.choice([None, 0.5, 2.0])) for _ in range(45)] + [(None, "n1", "CALLS", 1.0), ("n1", None, "CALLS", 1.0)]
    g = graph.clean(edge(spark, data))
    data = data[:-2]
    starts = spark.createDataFrame([("n1",), ("n2",), ("lonely",)], "node string")
    d = {(r.start, r.node): r.depth for r in graph.distances(g, starts, "out").collect()}
    assert d == {(s, n): k for s in ("n1", "n2", "lonely") for n, k in reach(data, s).items()}
    pairs = spark.createDataFrame([("n1", f"n{i}") for i in range(25)], "start string, goal string")
    p = {r.goal: r for r in graph.shortest_path(g, pairs).collect()}
    assert {k: r.length for k, r in p.items()} == reach(data, "n1")
    for r in p.values():
        assert r.path[0] == "n1" and all((a, b) in {(s, t) for s, t, *_ in data} for a, b in zip(r.path, r.path[1:]))
    paths = graph.simple_paths(g, pairs, 3, 1000).collect()

    def count(node, goal, left, seen):
        return sum(1 if t == goal else count(t, goal, left - 1, seen | {t}) for s, t, *_ in data if s == node and t not in seen and left)

    for i in range(25):
        assert sum(r.goal == f"n{i}" for r in paths) == (0 if i == 1 else count("n1", f"n{i}", 3, {"n1"}))
    deg = {r.node: (r.n_in, r.n_out) for r in graph.degrees(g).collect()}
    assert deg["n1"] == (sum(t == "n1" for _, t, *_ in data), sum(s == "n1" for s, *_ in data))


def test_components(spark):
    rng = random.Random(4)
    data = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 1), (5, 5)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in data:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(data, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_redirect_and_merge(spark, rows, five):
    g = edge(spark, [("1", "2", "CALLS", 1.0), ("2", "3", "USES", 1.0), ("1", "3", "USES", 1.0), ("3", "3", "USES", 1.0)])
    m = spark.createDataFrame([("1", "1"), ("2", "1")], "id string, primary_id string")
    assert rows(graph.redirect(g, m), "source_id", "target_id") == [("1", "3"), ("3", "3")]
    merged = resolve.merge(five, m)
    assert merged.count() == 4 and merged.where("id = '1'").first().metadata["aliases"] == "logout"


def test_duplicate_groups_are_greedy(spark):
    rng = random.Random(6)
    pairs = [(f"{a:02}", f"{b:02}", 0.9) for a, b in {(rng.randrange(30), rng.randrange(30)) for _ in range(40)} if a != b]
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for i in sorted(near):
        if i not in want:
            took = {x for x in near[i] if x > i and x not in want}
            if took:
                want.update(dict.fromkeys(took | {i}, i))
            else:
                want[i] = None  # a primary without duplicates
    got = {r.id: r.primary_id for r in resolve.duplicate_groups(spark.createDataFrame(pairs, "a string, b string, score double")).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_duplicates_go_to_the_least_primary(spark, rows):
    # 3 becomes a primary a round before 2, which waits for 1 to be taken
    pairs = [("0", "1", 0.9), ("1", "2", 0.9), ("2", "9", 0.9), ("3", "9", 0.9), ("3", "4", 0.9)]
    got = rows(resolve.duplicate_groups(spark.createDataFrame(pairs, "a string, b string, score double")))
    assert got == [("0", "0"), ("1", "0"), ("2", "2"), ("3", "3"), ("4", "3"), ("9", "2")]


def greedy(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, want = u @ u.T, {}
    for i in sorted(range(len(x)), key=str):
        took = {j for j in range(len(x)) if str(j) > str(i) and j not in want and s[i, j] >= least}
        if i not in want and took:
            want.update(dict.fromkeys(took | {i}, i))
    return {(str(i), str(p)) for i, p in want.items()}


def test_duplicate_groups_of_large_families(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 32))
    x[10:35] = x[10] + 0.3 * rng.standard_normal((25, 32))
    x[40:60] = x[40]
    x[60:80] = x[60] + 0.9 * rng.standard_normal((20, 32))
    x[80] = 2 * x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 32), (91, None), (92, [0.0] * 32)], "vec_id long, embedding array<float>")
    df.unionByName(df.where("vec_id = 5")).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = greedy(x.astype(np.float32).astype(float), 0.4)
    assert len(want) > 60
    assert set(rows(graph_queries.duplicate_groups(spark, str(tmp_path)))) == want


def test_reference_resolution(spark, rows, five):
    refs = spark.createDataFrame([("a", "src/auth.ts::login"), ("b", "src/auth.ts"), ("c", "UserStore"), ("d", "logout()"), ("e", "nope"), ("f", None)], "ref_id string, text string")
    assert rows(resolve.references(refs, five)) == [("a", "1", 1), ("b", "4", 2), ("c", "3", 3), ("d", "2", 4)]
    names = spark.createDataFrame([(1, "UserStores")], "query_id int, name string")
    assert rows(resolve.aliases(five, names, 0.7), "id") == [("3",)]


def test_skewed_lookup(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k = 'hot' or k like 'k1%'").withColumn("x", F.lit(1))
    got = joins.lookup(left, right, ["k"], "n")
    assert got.columns == ["k", "v", "x"] and got.count() == 900 + 111


def test_messages(spark, rows):
    data = [(f"{i}", "s", i, r, c, None, T[t]) for i, (r, c, t) in enumerate([("system", "x", 0), ("user", "q1", 1), ("user", "q2", 1), ("assistant", "a2", 2), ("user", "q3", 3), ("assistant", "a3", 4), ("user", "q4", 5)])]
    m = spark.createDataFrame(data, schemas.MESSAGES)
    assert rows(messages.pairs(m), "question", "answer") == [("q2", "a2"), ("q3", "a3")]
    assert rows(messages.pairs(m, 1), "question") == [("q3",)]
    assert rows(messages.recent(m, 2), "content", "nth") == [("a3", 1), ("q4", 2)]
    assert messages.transcript(m).first().transcript.startswith("system: x\n\nuser: q1")
    s = messages.template_summary(m).first()
    assert (s.n_user, s.n_assistant) == (4, 2)
    sums = spark.createDataFrame([("1", "s", 1, None, None, None, None, None, None, "1", 1, None, None), ("2", "s", 2, None, None, None, None, None, None, "3", 1, None, None)], schemas.SUMMARIES)
    assert rows(messages.since_summary(m, sums), "content") == [("a3",), ("q3",), ("q4",)]
    assert messages.latest_version(sums).first().version == 2
    d = spark.createDataFrame([("d1", "We decided to use Kafka", None), ("d2", "other", "kafka was slow")], "id string, description string, context string").withColumn("created_at", F.lit(T[0]))
    hits = messages.search_decisions(d, m.withColumn("content", F.lit("we chose kafka")).limit(1), "Kafka", 10).collect()
    assert [h.tier for h in hits] == [1, 2, 3]
    assert m.select(messages.may_decide(F.lit("Let's use Redis")).alias("x")).first().x


def test_whole_transcripts(spark, rows, tmp_path):
    data = [(f"{i:04}", "s", i, "user", "word " * 20, None, T[0]) for i in range(200)] + [("a", "s", None, "user", "no place", None, T[1]), ("b", "s", 3, "user", "no time", None, None)]
    spark.createDataFrame(data, schemas.MESSAGES).write.parquet(f"{tmp_path}/messages.parquet")
    got = messages.transcript(analytics_queries.msgs(spark, str(tmp_path))).first().transcript.split("\n\n")
    assert len(got) == 202 and got[0] == "user: no time" and got[-1] == "user: no place"


def test_memory(spark, rows):
    data = [(f"{i}", "s", "text about redis" if i == 5 else "x", "fact", t, a, None, T[i], r, 1500, {}, None) for i, (t, a, r) in enumerate([("hot", 5, 0.1), ("hot", 0, 0.2), ("hot", 1, 0.9), ("cold", 0, 0.5), ("cold", 9, 0.1), ("warm", 0, 0.5)])]
    m = spark.createDataFrame(data, schemas.MEMORY)
    s = analytics.memory_status(m).first()
    assert (s.hot_items, s.hot_tokens, s.hint_spill, s.hint_prune) == (3, 4500, True, False)
    assert rows(analytics.spill_candidates(m, 2), "id", "to_tier") == [("0", "warm"), ("1", "cold")]
    assert rows(analytics.prune_cold(m, 1), "id") == [("3",)]
    q = spark.createDataFrame([(1, "s", "redis text")], "query_id int, session_id string, text string")
    r = analytics.recall(m, q, 1).first()
    assert (r.id, r.tier, r.access_count, r.relevance_score) == ("5", "hot", 1, 1.0)


def test_feedback(spark, rows):
    f = spark.createDataFrame([("q", "e", s) for s in ("used", "used", "ignored", "explicit_positive", "explicit_negative")], "query_id string, entity_id string, signal string")
    s = analytics.feedback_stats(f)
    assert rows(s, "total", "use_rate") == [(5, 0.4)]
    res = spark.createDataFrame([(0, "e", 1.0), (0, "other", 1.0)], "query_id int, entity_id string, score double")
    assert rows(fusion.adjust_by_feedback(res, s), "entity_id", "multiplier") == [("e", pytest.approx(0.85)), ("other", 1.0)]
    e = spark.createDataFrame([("e", "parser", "fooBar bazQux")], "id string, name string, content string")
    got = analytics.used_in_response(spark.createDataFrame([("q", "e")], "query_id string, entity_id string"), spark.createDataFrame([("q", "uses foobar")], "query_id string, response string"), e)
    assert got.first().signal == "used"


def test_impact(spark, five):
    ch = spark.createDataFrame([("r", "src/auth.ts", "D"), ("r", "src/store.ts", "M")], "report_id string, path string, status string")
    g = edge(spark, [(f"x{i}", "3", "USES", 1.0) for i in range(6)])
    d = spark.createDataFrame([("d", ["1", "zz"])], "id string, entity_ids array<string>")
    r = analytics.impact(ch, five, g, d).first()
    assert (r.n_deleted, r.n_widely_used, r.n_invalidated, r.risk_score, r.risk_level) == (1, 1, 1, 7, "medium")


def test_changes(spark, rows):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    b = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "k string, h string")
    assert rows(changes.diff(a, b, "k", "h")) == [("a", "deleted"), ("b", "modified"), ("c", "unchanged"), ("d", "added")]
    r = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 2, 9), ("f", 11, 12), ("g", 1, 1)], "f string, s int, e int")
    assert rows(changes.merge_ranges(r, ["f"], "s", "e")) == [("f", 1, 9), ("f", 11, 12), ("g", 1, 1)]


def test_chunks(spark):
    assert chunks.spans("short") == [(0, 5)]
    text = "\n".join("x" * 80 for _ in range(100))
    s = chunks.spans(text, 1000, 100)
    assert s[0][0] == 0 and s[-1][1] == len(text) and all(e - a <= 1000 for a, e in s) and all(b[0] == a[1] - 100 for a, b in zip(s, s[1:]))
    assert all(text[e - 1] == "\n" for _, e in s[:-1])
    df = spark.createDataFrame([(1, text, "clash"), (2, None, ""), (3, "", "")], "id int, t string, piece string")
    got = chunks.chunk(df, "id", "t", 1000, 100).orderBy("id", "start").collect()
    assert [(r.start, r.end) for r in got if r.id == 1] == s and [(r.id, r.end) for r in got if r.id > 1] == [(2, 0), (3, 0)]
    p = chunks.section_pieces("\n\n".join("p" * 700 for _ in range(6)))
    assert len(p) > 2 and all(len(x) < 3000 for x in p)
    c = chunks.code_chunks(ent(spark, [("1", "function", "doIt", "line\n" * 600, "sums", "a/b/c.ts", 1, {})])).collect()
    assert len(c) == c[0].total > 2 and all(r.text.startswith("function: doIt do It doit\nin b/c.ts\nsums\n\n") and len(r.text) <= 1024 for r in c)


def test_documents(spark, rows, five):
    s = spark.createDataFrame([("s1", "See `UserStore` and src/auth.ts, call login() in AuthService."), ("s2", None)], "id string, content string")
    assert rows(documents.code_references(s, "id", "content"), "ref", "kind") == [("AuthService", "classname"), ("UserStore", "backtick"), ("login", "function"), ("src/auth.ts", "filepath")]
    assert rows(documents.mentions(s, "id", "content", five), "name", "confidence") == [("UserStore", 0.95)]
    text = "Intro\n- The system must log in users\n  within a second\n- Support for themes\nAcceptance criteria: shown\nmore\n1. Nice to have: icons"
    sec = spark.createDataFrame([("a", "Functional Requirements", text), ("b", "Notes", text), ("c", "Goals", None)], "section_id string, title string, content string")
    got = documents.requirements(sec).orderBy("nth").collect()
    assert [(r.kind, r.priority, r.description) for r in got] == [("requirement", "must", "The system must log in users within a second"), ("feature", None, "Support for themes"), ("requirement", "could", "Nice to have: icons")]
    assert got[1].acceptance == ["Acceptance criteria: shown", "more"] and got[0].title == "The system  log in users"
    story = spark.createDataFrame([("a", "t", "As a user, I want tabs, so that I find things")], "section_id string, title string, content string")
    assert rows(documents.user_stories(story), "role", "want") == [("user", "tabs")]


def test_critique(spark, rows):
    d = spark.createDataFrame([(1, "short", "c", ["a"]), (2, "I don't know what `Unknown` is, it always works", "login checks passwords", ["login"]), (3, "The login function checks passwords carefully", "login checks passwords carefully", ["login"])], "draft_id int, draft string, context string, names array<string>")
    assert rows(documents.critique(d), "draft_id", "issue") == [(1, "too_short"), (2, "absolute_claim"), (2, "unknown_reference"), (2, "unsure")]
    assert rows(documents.claims(d), "draft_id", "supported") == [(2, False), (3, True)]


def test_suggestions_and_subscriptions(spark, rows):
    r = spark.createDataFrame([(1, "d", "decision", 0.7, None), (1, "f", "function", 0.9, T[0]), (1, "s", "section", 0.6, None), (1, "g", "class", 0.4, T[0])], "query_id int, entity_id string, type string, score double, updated_at timestamp")
    assert rows(documents.suggestions(r), "entity_id", "kind", "rank") == [("d", "decision", 2), ("f", "change", 1)]
    ev = spark.createDataFrame([(1, "src/a/b.ts", T[1]), (2, "docs/x.md", T[1])], "event_id int, path string, ts timestamp")
    subs = spark.createDataFrame([("s1", "x", ["src/**"], 0.5, 5, 5000, None, True), ("s2", "x", ["**/*.md"], 0.5, 5, 5000, T[1], True), ("s3", "x", ["**"], 0.5, 5, 5000, None, False)], schemas.SUBSCRIPTIONS)
    assert rows(documents.subscriptions_due(ev, subs)) == [("s1", 1)]
