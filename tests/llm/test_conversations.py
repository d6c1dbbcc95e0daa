import datetime as dt

import pytest

from siftwell.llm import conversations as C

T = [dt.datetime(2024, 1, 1, 0, i) for i in range(20)]
SCHEMA = "id string, session_id string, position int, role string, content string, created_at timestamp, turn string"


def run(spark, data, sessions=()):
    m = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    s = spark.createDataFrame([(x,) for x in sessions], "session_id string").unionByName(m.select("session_id"))
    t = C.thread(C.clean(m), ("content",))
    drop = C.dropped(t, s)
    return t, drop, C.turns(t, drop)


def test_reasons_and_turns(spark, rows):
    data = [
        ("1", "good", 1, " User", "q", T[1]), ("2", "good", 2, "BOT", "a", T[2]), ("2b", "good", 7, "BOT", "a", T[2]), ("0", "good", 0, "system", "s", T[0]),
        ("3", "noreply", 1, "user", "q", T[1]), ("4", "noreply", 2, "ai", "a", T[2]), ("5", "noreply", 3, "human", "q2", T[3]),
        ("6", "starts", 1, "assistant", "a", T[1]), ("7", "norole", 1, "user", "q", T[1]), ("8", "norole", 2, "tool", "x", T[2]),
        ("9", "notime", 1, "user", "q", None), ("10", "blank", 1, "user", " \t\n", T[1]), ("11", "blank", 2, "system", "x", T[2]),
        ("12", None, 1, "user", "q", T[1]), ("13", "tie", 2, "assistant", "a", T[1]), ("14", "tie", 1, "user", "q", T[1]), ("1", "good", 1, " User", "q", T[1]),
    ]
    t, drop, kept = run(spark, data, ["bare", "good"])
    assert rows(drop) == sorted([("bare", "empty"), ("blank", "empty"), ("noreply", "no_reply"), ("norole", "broken"), ("notime", "broken"), ("starts", "broken")])
    assert rows(kept.select("session_id", "turn", "speaker", "content")) == [
        ("good", 0, "system", "s"), ("good", 1, "user", "q"), ("good", 2, "assistant", "a"), ("tie", 0, "user", "q"), ("tie", 1, "assistant", "a"),
    ]
    parts = C.conversations(kept, 2).orderBy("session_id", "part").collect()
    assert [(r.session_id, r.part, [x.content for x in r.turns]) for r in parts] == [("good", 0, ["s", "q"]), ("good", 1, ["a"]), ("tie", 0, ["q", "a"])]


def test_session_over_many_partitions(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(f"{i}", "hot" if i % 3 else f"s{i % 50}", i, "user" if i % 2 else "ai", f"m{i}", base + dt.timedelta(seconds=i)) for i in range(3000)]
    t, _, _ = run(spark, data)
    got = {}
    for r in t.collect():
        got.setdefault(r.session_id, []).append((r.turn, int(r.content[1:])))
    for x in got.values():
        x.sort()
        assert [i for i, _ in x] == list(range(len(x)))
        assert [n for _, n in x] == sorted(n for _, n in x)
    assert len(got["hot"]) == 2000


def test_resolve_parents(spark, rows):
    nodes = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (10, 99), (11, 10), (20, 21), (21, 22), (22, 20), (23, 20), (30, 30)]
    df = spark.createDataFrame([(i, p, 1) for i, p in nodes], "id int, parent int, weight int")
    assert dict((r[0], r[1:]) for r in rows(C.resolve_parents(df))) == {
        1: (1, 0, "ok"), 2: (1, 1, "ok"), 3: (1, 2, "ok"), 4: (1, 3, "ok"), 5: (1, 4, "ok"), 10: (10, 0, "orphan"), 11: (10, 1, "orphan"),
        20: (None, None, "cycle"), 21: (None, None, "cycle"), 22: (None, None, "cycle"), 23: (None, None, "cycle"), 30: (None, None, "cycle"),
    }
    long = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(500)], "id int, parent int, weight int")
    assert rows(C.resolve_parents(long), "depth") == sorted([(i,) for i in range(500)], key=str)


@pytest.mark.parametrize("data", [[], [("1", None, 1, None, None, None)]])
def test_empty(spark, rows, data):
    t, drop, kept = run(spark, data)
    assert rows(t) == rows(drop) == rows(kept) == []


def test_branches_orphans_and_cycles(spark, rows):
    tree = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "a"), ("x", None), ("o", "gone"), ("p", "o"), ("y", "z"), ("z", "y"), ("q", "z"), (None, "a"), ("c", "b")]
    tree += [(f"n{i:02}", f"n{i - 1:02}" if i else "x") for i in range(20)]
    df = spark.createDataFrame([(i, p, "user", None, "t") for i, p in tree], "id string, reply_to string, speaker string, created_at timestamp, content string")
    paths, left = C.branches(df, "reply_to", ("content",))
    got = {}
    for r in paths.orderBy("leaf", "turn").collect():
        got.setdefault(r.leaf, []).append(r.id)
        assert got[r.leaf][0] == r.root and len(got[r.leaf]) == r.turn + 1
    assert got == {"c": ["a", "b", "c"], "d": ["a", "b", "d"], "e": ["a", "e"], "n19": ["x"] + [f"n{i:02}" for i in range(20)]}
    assert rows(left) == [("o", "orphan"), ("p", "orphan"), ("q", "cycle"), ("y", "cycle"), ("z", "cycle")]
    none, left = C.branches(df.limit(0), "reply_to")
    assert none.collect() == left.collect() == []
