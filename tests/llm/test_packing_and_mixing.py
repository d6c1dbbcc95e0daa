import os
import random

import numpy as np
import pytest

from siftwell.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
SCHEMA = "doc_id long, text string, source string, n_tokens string"


def docs(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 400))), "abc"[i % 3 % 2 + (i % 10 == 0)], "clash") for i in range(n)]
    data += [(n, None, "a", ""), (n + 1, "", "a", ""), (n + 2, "word " * 5000, "b", ""), (n + 3, "x", None, "")]
    return spark.createDataFrame(data, SCHEMA), data


def test_sizes_equal_the_tokenizer(spark):
    df, data = docs(spark, 40)
    enc = tokens.sizer(tokens.VOCABULARY, 0).encoding
    got = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "doc_id", "text").collect()}
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t, _, _ in data}


def test_hilbert_is_a_walk():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = tokens.hilbert(g, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    df, data = docs(spark)
    size = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "doc_id", "text").collect()}
    limits = [("small", 128), ("large", 1000)]
    rows = packing.pack(df, "doc_id", "text", limits).collect()
    for name, cap in limits:
        used, parts = {}, {}
        for r in (r for r in rows if r.limit_name == name):
            if r.container_id is None:
                assert size[r.doc_id] is None
                continue
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        assert max(used.values()) <= cap
        for i, n in size.items():
            if n is not None:
                p = sorted(parts[i])
                assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:]))
                assert len(p) == max(1, -(-n // cap))
        assert sum(used.values()) / cap / len(used) > 0.95
    fill = {r.limit_name: r for r in packing.fill(packing.pack(df, "doc_id", "text", limits), limits).collect()}
    assert fill["small"].fullest <= 128 and fill["large"].n_tokens == sum(n or 0 for n in size.values())


def test_packing_an_empty_table(spark):
    df, _ = docs(spark, 3)
    assert packing.pack(df.limit(0), "doc_id", "text", [("s", 10)]).collect() == []


def test_mixing(spark):
    df, data = docs(spark, 600)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 6), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(df, "doc_id", "text", "source", targets)
    u = {r.doc_id: r for r in uses.collect()}
    assert len(u) == len(data)
    most = {"a": 1, "b": 4, "c": 6}
    assert all(0 <= r.copies <= most.get(r.source, 0) for r in u.values())
    assert u[600].copies == 0 and u[603].copies == 0
    rep = {r.source: r for r in report.collect()}
    total = sum(r.copies * (r.n_tokens or 0) for r in u.values())
    largest = {s: max(r.n_tokens or 0 for r in u.values() if r.source == s) for s in most}
    for s in most:
        assert rep[s].mixed_tokens == sum(r.copies * (r.n_tokens or 0) for r in u.values() if r.source == s)
        assert abs(rep[s].mixed_tokens - rep[s].wanted_share * total) <= sum(largest.values())
    assert rep["none"].mixed_tokens == 0 and rep["none"].wanted_share == 0


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(40)]
    fractions = [rng.random() for _ in sizes]
    mass = sum(s * f for s, f in zip(sizes, fractions))
    hits = np.zeros(40)
    for seed in range(400):
        p, out = mixing.Pivot(seed), []
        for i, (s, f) in enumerate(zip(sizes, fractions)):
            out += p.add((i,), s, f)
        left = p.held[1] * p.held[2] if p.held else 0
        assert abs(sum(sizes[r[0]] * x for r, x in out) + left - mass) < 1e-6
        for r, x in out:
            hits[r[0]] += x
        if p.held:
            hits[p.held[0][0]] += p.held[2]
    assert np.abs(hits / 400 - fractions).max() < 0.12


def test_a_source_that_falls_short(spark):
    plan = mixing.plan([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 1000}, total=1000)
    assert plan["a"]["copies"] == 1 and plan["b"]["copies"] == 0.5


def test_mixing_an_empty_table(spark):
    df, _ = docs(spark, 3)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(df.limit(0), "doc_id", "text", "source", targets)
    assert uses.collect() == [] and report.first().mixed_tokens == 0
    uses, report = mixing.mix(df, "doc_id", "text", "source", targets.limit(0))
    assert {r.copies for r in uses.collect()} == {0} and report.collect() == []


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "some words " * 100_000), (2, "x")], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in tokens.sizes(df, "doc_id", "text").collect()}
    rows = packing.pack(df, "doc_id", "text", [("s", 1000)]).collect()
    assert sum(r.n_tokens for r in rows) == sum(n.values()) and max(r.n_tokens for r in rows) == 1000


def test_outcomes_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 50)
    monkeypatch.setattr(packing, "STRETCH", 100)
    df, _ = docs(spark, 600)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 6)], "source string, target_share double, max_repeats int")
    seen = []
    for parts, batch in ((1, 10_000), (7, 30)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            x = df.repartition(parts)
            uses, report = mixing.mix(x, "doc_id", "text", "source", targets)
            seen.append((sorted(map(str, uses.collect())), sorted(map(str, report.collect())), sorted(map(str, packing.pack(x, "doc_id", "text", [("s", 128), ("l", 999)]).collect()))))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1]
