import json

import numpy as np
import pytest

from siftwell.llm import vptree as V


def data(n=700, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[1::7] = x[::7][: len(x[1::7])] + 0.15 * rng.standard_normal((len(x[1::7]), dims))
    return x


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: {int(j) for j in np.argsort(-s[i])[:k] if s[i, j] >= least} for i in range(len(x))}


def table(spark, x, collection="c"):
    return spark.createDataFrame([(collection, f"k{i:04}", v.tolist()) for i, v in enumerate(x)], "collection string, key string, vector array<double>")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(int(r.key[1:]), set()).add(int(r.other[1:]))
    return out


def test_relax_of_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "LEAF", 16)
    x = data()
    assert found(V.neighbours(table(spark, x), 10, relax=1.0)) == brute(x, 10, -1)
    want = {k: v for k, v in brute(x, 5, 0.9).items() if v}
    assert found(V.neighbours(table(spark, x), 5, least=0.9, relax=1.0)) == want
    assert len(want) > 100


def test_relaxed_recall(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "LEAF", 16)
    x = data(900, 32)
    want = {k: v for k, v in brute(x, 10, 0.9).items() if v}
    got = found(V.neighbours(table(spark, x), 10, least=0.9))
    assert sum(len(got.get(k, set()) & v) for k, v in want.items()) >= 0.97 * sum(map(len, want.values()))
    want = brute(x, 10, -1)
    got = found(V.neighbours(table(spark, x), 10, relax=0.5))
    assert sum(len(got.get(k, set()) & v) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_blocks_of_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    x = data(300, 8)
    assert found(V.neighbours(table(spark, x), 4, relax=1.0)) == brute(x, 4, -1)


def test_repeats_ties_nulls_and_single_rows(spark, rows):
    data_ = [("c", "a", [1.0, 0.0]), ("c", "a", [1.0, 0.0]), ("c", "b", [2.0, 0.0]), ("c", "d", [0.0, 1.0]), ("c", None, [1.0, 0.0]), ("one", "z", [1.0])]
    df = spark.createDataFrame(data_, "collection string, key string, vector array<double>")
    got = [(r.key, r.other, r["rank"]) for r in V.neighbours(df, 10, relax=1.0).collect()]
    assert sorted(got) == [("a", "b", 1), ("a", "d", 2), ("b", "a", 1), ("b", "d", 2), ("d", "a", 1), ("d", "b", 2)]
    assert V.neighbours(df.limit(0), 3).collect() == []


def test_usable_vectors(spark, rows):
    good, bad = [1.0, 2.0], [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, None], [], None, [1.0, 2.0, 3.0]]
    data_ = [("c", f"g{i}", good) for i in range(9)] + [("c", f"b{i}", v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data_, "collection string, key string, vector array<double>")
    assert {r.key for r in V.usable(df, "vector").collect()} == {f"g{i}" for i in range(9)}


@pytest.mark.parametrize("text,want", [("[1, 2.5e0]", [1.0, 2.5]), (" [1,\n2 ]", [1.0, 2.0]), ("[1, NaN]", None), ('{"a": 1}', None), ("[1, null]", None), ("[1", None), (None, None), ("[true]", None), (json.dumps([]), [])])
def test_parse_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(V.parse_json("t").alias("v")).first().v
    assert got == want
