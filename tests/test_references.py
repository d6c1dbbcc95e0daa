import datetime as dt

from pyspark.sql import functions as F

from siftwell.operators import references as R

T = [dt.datetime(2024, m, 1) for m in range(1, 7)]


def report(spark, refs, ents, gone):
    r = spark.createDataFrame(refs, "ref_table string, ref_field string, row_key string, key string, at timestamp, kind string")
    e = spark.createDataFrame(ents, "key string, at timestamp, refs int")
    g = spark.createDataFrame(gone, "key string, x int")
    return R.report(r, e, g)


def test_kinds(spark, rows):
    refs = [
        ("t", "f", "1", "a", T[1], "clash"), ("t", "f", "2", "a", T[3], ""), ("t", "f", "3", "gone", T[0], ""), ("t", "f", "4", "never", T[0], ""),
        ("t", "f", "5", None, T[0], ""), ("t", "f", "4", "never", T[0], ""), ("t", "f", "6", "back", T[2], ""), ("t", "f", "7", "never", None, ""), ("t", "f", "8", " a", T[1], ""),
    ]
    got = rows(report(spark, refs, [("a", T[2], 1), ("a", T[2], 2), ("back", None, 0), (None, T[0], 0)], [("gone", 1), ("gone", 1), ("back", 1)]))
    assert got == sorted(
        [("t", "f", "1", "late", "2024-02"), ("t", "f", "3", "deleted", "2024-01"), ("t", "f", "4", "missing", "2024-01"), ("t", "f", "7", "missing", None), ("t", "f", "8", "missing", "2024-02")], key=str
    )


def test_hot_keys_and_many_cold_ones(spark, rows):
    refs = [("t", "f", f"h{i}", "hot", T[0], "") for i in range(1000)] + [("t", "f", f"c{i}", f"k{i}", T[0], "") for i in range(1000)]
    got = report(spark, refs, [(f"k{i}", T[0], 0) for i in range(0, 1000, 2)], [("hot", 1)])
    assert got.where("kind = 'deleted'").count() == 1000
    assert got.where("kind = 'missing'").count() == 500


def test_empty_tables(spark, rows):
    assert rows(report(spark, [], [], [])) == []
    assert rows(report(spark, [], [("a", T[0], 1)], [("b", 1)])) == []
    assert rows(report(spark, [("t", "f", "1", "a", T[0], "")], [], []), "kind") == [("missing",)]


def test_counts_are_maintained_from_deltas(spark, rows):
    from pyspark.sql import functions as F

    def d(data):
        x = spark.createDataFrame(data, "k string, r int, e int")
        return R.deltas(x, F.col("k"), references=F.col("r"), existence=F.col("e"))

    state = R.accumulate(d([("a", 2, 1), ("b", 1, 0), ("c", 1, 1), (None, 1, 0)]))
    assert rows(R.orphans(state), "key", "refs") == [("b", 1)]
    state = R.accumulate(state, d([("b", 0, 1), ("c", 0, -1), ("a", -2, -1)]))
    assert rows(R.orphans(state), "key", "refs") == [("c", 1)]


def test_a_state_kept_over_rounds_of_changes(spark, rows):
    def feed(data, **kinds):
        df = spark.createDataFrame(data, "key string, n int")
        return R.deltas(df, F.col("key"), **{k: F.col("n") for k in kinds})

    first = R.advance(None, feed([("a", 1), ("b", 1), ("c", 1)], references=1), feed([("a", 1)], existence=1))
    assert rows(R.orphans(first), "key", "kind") == [("b", "missing"), ("c", "missing")]
    # b arrives late, a is deleted and its removal logged, c's reference goes, d is referred to twice and loses one reference
    second = R.advance(first, feed([("b", 1), ("a", -1)], existence=1), feed([("a", 1)], removals=1), feed([("c", -1), ("d", 2), ("d", -1)], references=1))
    assert rows(R.orphans(second), "key", "kind") == [("a", "deleted"), ("d", "missing")]
    assert "c" not in [r.key for r in second.collect()]
    # the same changes in one round
    at_once = R.advance(None, feed([("a", 1), ("b", 1), ("c", 1), ("c", -1), ("d", 1)], references=1), feed([("a", 1), ("b", 1), ("a", -1)], existence=1), feed([("a", 1)], removals=1))
    assert rows(R.orphans(at_once), "key", "refs", "kind") == rows(R.orphans(second), "key", "refs", "kind")
