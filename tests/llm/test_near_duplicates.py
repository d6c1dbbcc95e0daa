import random

import numpy as np
import pytest

from siftwell.llm import golay as G


def test_code_corrects_three_errors():
    rng = random.Random(1)
    codewords = (np.arange(4096) << 11) | G._PARITY
    assert (G.decode(codewords) == np.arange(4096)).all()
    for n in (1, 2, 3):
        for _ in range(20):
            e = sum(1 << b for b in rng.sample(range(23), n))
            assert (G.decode(codewords ^ e) == np.arange(4096)).all()


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 23, 3000)
    flips = np.array([(1 << a) | (1 << b) for a, b in rng.integers(0, 23, (3000, 2))])
    x, y = (set(zip(*map(np.ndarray.tolist, G.keys(w)))) for w in (v, v ^ flips))
    assert {i for i, _ in x & y} == set(range(3000))
    assert set(np.bincount(G.keys(v)[0])) <= {1, 6}


def similarity(a, b, width):
    def shingles(t):
        w = G.words(t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        texts[f"a{i:03}"] = " ".join(words)
        edited = list(words)
        for _ in range(rng.randint(0, len(words) // 25)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        if i % 3 == 0:  # a passage moves
            k = len(edited) // 2
            edited = edited[k:] + edited[:k]
        texts[f"b{i:03}"] = " ".join(edited)
    return texts


@pytest.mark.parametrize("width,threshold", [(3, 0.7), (5, 0.8)])
def test_pairs_equal_brute_force(spark, rows, width, threshold):
    texts = corpus()
    texts["copy"] = texts["a000"].upper() + " "
    data = [(k, v, 1) for k, v in texts.items()] + [("null", None, 1), ("empty", "", 1), ("short", "one two", 1), (None, texts["a001"], 1), ("a000", texts["a000"], 2)]
    df = spark.createDataFrame(data, "id string, text string, keys int")
    members, pairs = G.near_duplicates(df, "id", "text", width, threshold)
    got = rows(G.expand(members, pairs))
    ids = sorted(texts)
    want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(texts[a], texts[b], width) >= threshold]
    assert len(want) > 30
    assert got == sorted(want, key=str)
    assert dict(rows(members))["copy"] == dict(rows(members))["a000"] == "a000"
    assert "short" not in dict(rows(members))


def test_crowded_keys_go_through_the_prefix_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(G, "BUCKET", 3)
    monkeypatch.setattr(G, "HOT_KEYS", 10)
    rng = random.Random(5)
    base = [f"x{i}" for i in range(120)]
    texts = {}
    for i in range(40):  # a family of near-copies
        w = list(base)
        w[rng.randrange(120)] = f"y{i}"
        w[rng.randrange(120)] = f"z{i}"
        texts[f"f{i:02}"] = " ".join(w)
    header = " ".join(f"licence{i}" for i in range(40))
    for i in range(40):  # a passage that many records hold, and nothing else in common
        texts[f"h{i:02}"] = header + " " + " ".join(f"h{i}v{j}" for j in range(60))
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    members, pairs = G.near_duplicates(df, "id", "text", 3, 0.7)
    got = rows(pairs.select("a", "b"))
    ids = sorted(texts)
    want = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(texts[a], texts[b], 3) >= 0.7]
    assert len(want) == 780
    assert got == sorted(want, key=str)


def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "id string, text string")
    members, pairs = G.near_duplicates(df, "id", "text")
    assert rows(members) == rows(pairs) == []


def test_very_long_record(spark, rows):
    rng = random.Random(9)
    words = [f"w{rng.randrange(100000)}" for _ in range(560_000)]
    edited = words[:280_000] + ["new"] * 10 + words[280_000:]
    df = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(edited)), ("c", "x")], "id string, text string")
    assert rows(G.near_duplicates(df, "id", "text")[1], "a", "b") == [("a", "b")]


def met(texts, near):
    """Pairs of records that share a key, and those whose meeting windows all differ somewhere."""
    w = G.Words([G.words(t) for t in texts])
    owner, parts = w.windows()
    nth, key = G.window_keys(parts, near)
    held = {}
    for k, i in zip(key.tolist(), nth.tolist()):
        held.setdefault(k, set()).add(i)
    pairs, same = set(), set()
    for windows in held.values():
        for i in windows:
            for j in windows:
                if owner[i] < owner[j]:
                    pairs.add((owner[i], owner[j]))
                    if (parts[i] == parts[j]).all():
                        same.add((owner[i], owner[j]))
    return pairs, pairs - same


def test_neighbouring_codewords_bring_more_records_together():
    rng = random.Random(8)
    texts = []
    for _ in range(600):  # every eighth word or so of the copy is another one
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(f"x{rng.randrange(3000)}" if rng.random() < 0.13 else w for w in words)]
    more, different = met(texts, True)
    fewer, _ = met(texts, False)
    assert fewer < more and len(more) >= len(fewer) + 50
    assert len(different) >= 50  # they meet though no window of the two is the same
