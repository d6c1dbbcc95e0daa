import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import splitting as S


def greedy(places, core):
    out, at = [places[0]], 0
    while at < len(places) - 1:
        nxt = at + 1
        while nxt + 1 < len(places) and places[nxt + 1] - places[at] <= core:
            nxt += 1
        out.append(places[nxt])
        at = nxt
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(30, 60))
def test_pointer_doubling_equals_greedy(gaps, core):
    places = [np.concatenate([[0], np.cumsum(g)]) for g in gaps]
    assert [c.tolist() for c in S.Successors(places, core).cuts()] == [greedy(p.tolist(), core) for p in places]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("a" * 20 + "\n \n" + "b" * 20, "paragraph"),
        ("a" * 20 + "\n" + "b" * 20, "line"),
        ("a" * 20 + ". " + "b" * 20, "sentence"),
        ("漢" * 20 + "。" + "字" * 20, "sentence"),
        ("a" * 20 + " " + "b" * 20, "word"),
        ("a" * 50, "none"),
        ("a" * 20 + "\n\n" + "b" * 20 + " " + "c" * 20, "word"),
    ],
)
def test_kinds(text, kind):
    assert S.cut([text, text], 25)[1][0] == kind


def test_pieces(spark):
    rng = random.Random(4)
    texts = {}
    for i in range(30):
        seps = [" ", "\n", "\n\n", ". ", ""][: rng.randint(1, 5)]
        texts[f"t{i}"] = "".join("x" * rng.randint(1, 120) + rng.choice(seps) for _ in range(rng.randint(1, 120)))
    data = [(k, v, 10, "clash") for k, v in texts.items()] + [("null", None, 1, ""), ("empty", "", 1, ""), ("noline", "a\nb", None, "")]
    df = spark.createDataFrame(data, "id string, content string, start int, piece string")
    got = {}
    for r in S.split(df, "id", "content", 300, 40, "start").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {*texts, "noline"}
    assert got["noline"][0].start_line is None
    for k, t in texts.items():
        ps = got[k]
        assert [p.chunk_index for p in ps] == list(range(len(ps)))
        assert ps[0].char_start == 0 and ps[-1].char_end == len(t)
        for p in ps:
            assert p.piece == t[p.char_start : p.char_end] and 0 < len(p.piece) <= 300
            assert p.start_line == 10 + t.count("\n", 0, p.char_start)
        for a, b in zip(ps, ps[1:]):
            assert b.char_start == max(0, a.char_end - 40)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert S.split(df, "id", "content").collect() == []


def test_very_long_text(spark):
    t = ("word " * 50 + "\n") * 4000
    df = spark.createDataFrame([("a", t)], "id string, content string")
    r = S.split(df, "id", "content").orderBy("chunk_index").collect()
    assert max(len(x.piece) for x in r) <= 3000 and r[-1].char_end == len(t)


def test_kinds_come_from_the_successor_table():
    table = S.Successors([np.array([0, 10, 20]), np.array([0, 30, 40]), np.array([0, 5])], 25)
    assert table.legal().tolist() == [True, False, True]
    assert S.Successors([], 25).cuts() == [] and S.cut([], 25) == []
