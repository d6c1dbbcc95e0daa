import random

import pytest

from siftwell.llm import spans as S


def brute(texts, least):
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i : i + least], set()).add(d)
    out = []
    for d, t in texts.items():
        mark = [False] * len(t)
        for i in range(len(t) - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                mark[i : i + least] = [True] * least
        i = 0
        while i < len(t):
            if mark[i]:
                e = i
                while e < len(t) and mark[e]:
                    e += 1
                out.append((d, i, e))
                i = e
            i += 1
    return sorted(out)


def corpus(seed, alphabet, n=30):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(15, 90))) for _ in range(6)]
    texts = {}
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))]))
        texts[i] = "".join(parts)
    return texts


@pytest.mark.parametrize("bits", [1 << 12, S.MOST_BITS])
@pytest.mark.parametrize("seed,alphabet,least", [(1, "abcdefgh", 20), (2, "ab", 20), (3, "aé漢😀b", 11), (4, "a", 20)])
def test_equal_to_brute_force(spark, rows, monkeypatch, seed, alphabet, least, bits):
    monkeypatch.setattr(S, "MOST_BITS", bits)
    texts = corpus(seed, alphabet)
    data = [(k, v, "x") for k, v in texts.items()] + [(1000, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, h string")
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in S.shared_spans(df, "doc_id", "text", least).collect())
    assert got == brute(texts, least)
    cover = {r.doc_id: r for r in S.coverage(df, S.shared_spans(df, "doc_id", "text", least), "doc_id", "text").collect()}
    assert cover[1000].shared_share is None and len(cover) == len(texts) + 1


def test_copies_and_empty_tables(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (2, t), (3, t[:250]), (4, "short"), (5, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in S.shared_spans(df, "doc_id", "text").collect())
    assert got == [(1, 0, 300), (2, 0, 300), (3, 0, 250)]
    assert S.shared_spans(df.limit(0), "doc_id", "text").collect() == []


def test_strips_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "STRIP", 64)
    S._powers.cache_clear()
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 5, 9, 10, 63, 64, 65, 73, 74, 300)]
    width, seen = 10, {}
    for s in S.strips(texts, width):
        h, ok = s.hashes(slice(None), width), s.valid(width)
        for at in range(len(h)):
            own = max(i for i in range(len(s.start)) if s.start[i] <= at)
            if ok[at]:
                place = (int(s.owner[own]), int(s.offset[own] + at - s.start[own]))
                assert place not in seen
                seen[place] = int(h[at])
                assert int(s.hashes(S.np.array([at]), width)[0]) == int(h[at])
    windows = {(d, i): t[i : i + width] for d, t in enumerate(texts) for i in range(len(t) - width + 1)}
    assert set(seen) == set(windows)
    by = {}
    for p, w in windows.items():
        by.setdefault(w, set()).add(seen[p])
    assert all(len(h) == 1 for h in by.values()) and len({min(h) for h in by.values()}) == len(by)
    S._powers.cache_clear()


def test_very_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij") for _ in range(1_200_000))
    at = (1 << 20) - 250
    other = "#" * 30 + long[at : at + 600] + "#" * 30
    df = spark.createDataFrame([(1, long, 0, 0), (2, other, 0, 0)], "s long, text string, at int, h int")
    got = sorted(tuple(r) for r in S.shared_spans(df, "s", "text").collect())
    assert got == [(1, at, at + 600), (2, 30, 630)]


def test_anchors_are_the_least_blocks_and_a_fixed_share_of_the_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (10, 39, 40, 41, 500, 3000)]
    block, least = 20, 40
    for s in S.strips(texts, least):
        start, at = s.anchors(block, least)
        h = s.hashes(slice(None), block) >> S.np.uint64(22)
        assert sorted(start.tolist()) == [b + i for b, n in zip(s.start, s.length) for i in range(n - least + 1)]
        for b, p in zip(start, at):
            window = h[b : b + least - block + 1]
            assert p == b + int(S.np.argmin(window))
        assert len(set(at.tolist())) < 3 * len(start) / (least - block + 2)
