"""Near-duplicate records by Golay-code fuzzy hashing.

The binary Golay code (23, 12) is perfect: every 23-bit word lies within 3 bits of exactly one
of its 4096 codewords. A word's keys are the codewords its neighbours within one bit decode to,
1 or 6 of them; any two words up to 2 bits apart have a key in common.

A record's fingerprint is made of windows of nine words, laid around the first occurrences of its
``WINDOWS`` words of least hash, so that insertions and moved passages do not shift them. A window is
three segments of three words; a segment is a 23-bit word to which each of its words gives eight bits (the
last one seven). Errors are dealt with by the pigeonhole principle: where a window differs in one segment
only, the other two agree, and an edit of few bits in the third leaves it a codeword in common. So a
window's keys are, for each of its segments, the nearby codeword indices of that segment together with
the indices and syndromes of the other two: 3 to 18 keys of 60 bits. The words that place a window are no part of its keys.
Records that meet in a key are verified by their sets of shingles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.joins import lookup, spread
from siftwell.runtime import balanced, materialize

#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Windows of a fingerprint, segments of a window, words of a segment.
WINDOWS, PARTS, RUN = 6, 3, 3
#: Words hashed at once.
STRIP = 1 << 19
_WORD = re.compile(r"[^\W_]+")
_LOW = np.uint64((1 << 44) - 1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=np.uint64)


def _remainder(x: int) -> int:
    for b in range(22, 10, -1):
        if x >> b & 1:
            x ^= GENERATOR << (b - 11)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each message, and the error of at most 3 bits for each syndrome."""
    parity = np.array([_remainder(m << 11) for m in range(4096)], dtype=np.int64)
    bit = [(1 << i, _remainder(1 << i)) for i in range(23)] + [(0, 0)]
    error = np.zeros(2048, dtype=np.int64)
    for i, (a, sa) in enumerate(bit):
        for j, (b, sb) in enumerate(bit[i:]):
            for c, sc in bit[i + j :]:
                if len({a, b, c} - {0}) + (0 in (a, b, c)) * ((a, b, c).count(0)) == 3:
                    error[sa ^ sb ^ sc] = a ^ b ^ c
    return parity, error


_PARITY, _ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[(words & 0x7FF) ^ _PARITY[words >> 11]]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of the words within one bit: (number of the word, index), each pair once."""
    near = decode(words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :])
    near.sort(axis=1)
    first = np.concatenate([np.ones((len(words), 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
    return np.nonzero(first)[0], near[first]


def window_keys(parts: np.ndarray, near: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys of windows given as three 23-bit words each: (number of the window, key).

    With ``near`` off a segment has only the index that it decodes to itself.
    """
    nth, out = [], []
    for k in range(PARTS):
        if near:
            n, index = keys(parts[:, k])
        else:
            n, index = np.arange(len(parts)), decode(parts[:, k])
        x, y = (parts[n, j] for j in range(PARTS) if j != k)
        nth.append(n)
        out.append(k << 58 | x << 35 | y << 12 | index)
    return np.concatenate(nth), np.concatenate(out)


def mix(x: np.ndarray, m: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[m]
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


class Words:
    """Word hashes of records end to end, and their shingles. Shingle hashes have 44 bits, so that owner and hash sort as one number."""

    def __init__(self, texts: list[list[str]]) -> None:
        if len(_hashes) > 1 << 20:
            _hashes.clear()
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        flat = itertools.chain.from_iterable(texts)
        self.hash = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, int(self.length.sum()))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner << 44 | hash of each run of ``width`` words, and its place."""
        n = np.maximum(0, self.length - width + 1)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.start, n)
        h = self.hash[at] * _MIX[5]
        for k in range(1, width):
            h = (h ^ (h >> np.uint64(32))) * _MIX[0] + self.hash[at + k] * _MIX[5]
        return (owner.astype(np.uint64) << np.uint64(44)) | (mix(h, 2) >> np.uint64(20)), at

    def windows(self, most: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
        """Owner and the three 23-bit words of each window of the fingerprint; bits of words beyond the record's ends are 0."""
        code, at = self.shingles(1)
        owner = (code >> np.uint64(44)).astype(np.int64)
        size = np.bincount(owner, minlength=len(self.length))
        # hashes are even, so that a low enough part of them holds the least ones; records for which it doesn't are taken whole
        limit = np.minimum(1.0, 4 * most / np.maximum(1, size)) * float(1 << 44)
        low = (code & _LOW) <= limit.astype(np.uint64)[owner]
        while True:
            c, p = code[low], at[low]
            o = np.argsort(c, kind="stable")
            c, p = c[o], p[o]
            new = np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
            c, p = c[new], p[new]
            own = (c >> np.uint64(44)).astype(np.int64)
            count = np.bincount(own, minlength=len(size))
            short = (count < most) & (np.bincount(owner[low], minlength=len(size)) < size)
            if not short.any():
                break
            low |= short[owner]
        rank = np.arange(len(c)) - (np.cumsum(count) - count)[own]
        p, own = p[rank < most], own[rank < most]
        lo, hi = self.start[own], self.start[own] + self.length[own]
        parts = np.zeros((len(p), PARTS), dtype=np.int64)
        for k in range(PARTS * RUN):
            q = p + k - PARTS * RUN // 2
            w = mix(self.hash[np.clip(q, 0, len(self.hash) - 1)], 1) >> np.uint64(40)
            nth, bits = k % RUN, 23 // RUN + (k % RUN < 23 % RUN)
            at_bit = nth * (23 // RUN) + min(nth, 23 % RUN)
            parts[:, k // RUN] |= np.where((q >= lo) & (q < hi), w.astype(np.int64) & ((1 << bits) - 1), 0) << at_bit
        return own, parts


class Sets:
    """Distinct shingle hashes of records, sorted by owner and hash."""

    def __init__(self, words: Words, width: int) -> None:
        c = np.sort(words.shingles(width)[0])
        c = c[np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]]
        self.hash = c & _LOW
        self.count = np.bincount((c >> np.uint64(44)).astype(np.int64), minlength=len(words.length))
        self.first = np.cumsum(self.count) - self.count

    def digest(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for each record's set."""
        out = []
        for m in (3, 4):
            c = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hash + np.uint64(1), m))])
            out.append((c[self.first + self.count] - c[self.first]).view(np.int64))
        return out[0], out[1]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: A key met by more records than BUCKET is left to the prefix filter; one that holds over HOT_SHARE of the
#: records of any strip, and over 1/HOT_KEYS of all, is taken out before anything is shuffled.
BUCKET, HOT_SHARE, HOT_KEYS = 200, 0.02, 500
#: Sets that share a shingle and are compared by one task, in the prefix filter.
HOLDERS = 512
#: Sets that a task remembers, so that copies among them send no keys.
REMEMBERED = 1 << 20


def _strips(ids: list, texts: list[str], least: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Records of at least ``least`` words, in strips of about STRIP words."""
    held_ids, held, n = [], [], 0
    for i, t in zip(ids, texts):
        w = words(t)
        if len(w) < least:
            continue
        held_ids.append(i)
        held.append(w)
        n += len(w)
        if n >= STRIP:
            yield held_ids, held
            held_ids, held, n = [], [], 0
    if held:
        yield held_ids, held


def sketches(records: DataFrame, width: int, least: int, near: bool = True) -> DataFrame:
    """id, c1, c2 (128 bits of the record's shingle set), n (its size), keys (null for copies that the task met before).

    Rows without an id carry a key in c1 that is hot in one strip and its count there in c2.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for ids, texts in _strips(b["id"].tolist(), b["text"].tolist(), least):
                w = Words(texts)
                sh = Sets(w, width)
                c1, c2 = sh.digest()
                owner, parts = w.windows()
                nth, key = window_keys(parts, near)
                order = np.argsort(owner[nth], kind="stable")
                nth, key = nth[order], key[order]
                ends = np.searchsorted(owner[nth], np.arange(len(ids) + 1))
                if len(seen) > REMEMBERED:
                    seen.clear()
                sent = []
                for i, c in enumerate(c1.tolist()):
                    sent.append(None if c in seen else key[ends[i] : ends[i + 1]])
                    seen.add(c)
                yield pd.DataFrame({"id": ids, "c1": c1, "c2": c2, "n": sh.count.astype(np.int32), "keys": sent})
                value, count = np.unique(key, return_counts=True)
                hot = count > max(20, HOT_SHARE * len(ids))
                yield pd.DataFrame({"id": None, "c1": value[hot], "c2": count[hot], "n": 0, "keys": None})

    return records.mapInPandas(run, f"id {records.schema['id'].dataType.simpleString()}, c1 long, c2 long, n int, keys array<long>")


def _meetings(threshold: float, most: int):
    """Pairs of different sets that meet in a key, from rows sorted by key; sets of keys with more than ``most`` rows come with a null."""

    def pairs(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        big = np.repeat(size > most, size)
        yield pd.DataFrame({"a": c[big], "b": pd.array([None] * int(big.sum()), dtype="Int64")})
        k, c, n = k[~big], c[~big], n[~big]
        d = 1
        while d < len(k):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            x, y = same, same + d
            ok = (c[x] != c[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            yield pd.DataFrame({"a": np.minimum(c[x], c[y]), "b": pd.array(np.maximum(c[x], c[y]), dtype="Int64")}).drop_duplicates()
            d += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not len(b):
                continue
            k, c, n = (np.concatenate([h, b[col].to_numpy()]) for h, col in zip(held, ("key", "c1", "n")))
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if cut:
                yield from pairs(k[:cut], c[:cut], n[:cut])
            held = [k[cut:], c[cut:], n[cut:]]
            if len(held[0]) > 4 * most:  # a hot key: all but enough of it to stay hot can go
                over = held[1][2 * most :]
                yield pd.DataFrame({"a": over, "b": pd.array([None] * len(over), dtype="Int64")})
                held = [h[: 2 * most] for h in held]
        if len(held[0]):
            yield from pairs(*held)

    return run


def shingle_sets(records: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, set of shingle hashes of the records whose id is in ``ids`` (a stored table).

    The records are thinned by a filter of bounded size before they are joined.
    """
    from siftwell.llm.spans import Filter

    wanted = records.sparkSession.sparkContext.broadcast(Filter.build(ids.select(F.xxhash64("id").alias("h")), ids.count()).words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(wanted.value)
        for b in batches:
            b = b[known.has(b["h"].to_numpy().view(np.uint64))]
            for some, texts in _strips(b["id"].tolist(), b["text"].tolist(), width):
                s = Sets(Words(texts), width)
                h = s.hash.view(np.int64)
                yield pd.DataFrame({"id": some, "shingles": [h[f : f + c] for f, c in zip(s.first, s.count)]})

    kind = records.schema["id"].dataType.simpleString()
    sets = balanced(records).withColumn("h", F.xxhash64("id")).mapInPandas(run, f"id {kind}, shingles array<long>")
    return sets.join(ids, "id").dropDuplicates(["id", "c1"])


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Every pair of sets that may reach ``threshold``: those that share one of the rarest shingles of both.

    A set of n needs n - ceil(threshold n) + 1 of its shingles in the common order to meet every set
    it is that similar to. Rarest first leaves passages that many records hold out of the join.
    """
    # the size is taken before the rows are exploded, or each of them would carry the whole set
    each = sets.select("c1", F.size("shingles").alias("n"), "shingles").select("c1", "n", F.explode("shingles").alias("s"))
    rare = materialize(each.groupBy("s").agg(F.count("*").alias("_n")))
    ranked = (
        lookup(each, rare.withColumn("f", F.col("_n")), ["s"], "_n")
        .groupBy("c1", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))
        .select("c1", "n", F.explode(F.expr(f"slice(o, 1, n - cast(ceil({threshold} * n - 1e-9) as int) + 1)")).alias("x"))
        .select("c1", "n", F.col("x.s").alias("s"))
    )
    ranked = materialize(ranked)
    # a shingle of many sets is cut into blocks of them, and every two blocks meet in a task of their own
    blocks = F.ceil(F.col("_m") / HOLDERS).cast("int")
    held = materialize(ranked.groupBy("s").agg(F.count("*").alias("_m")).where("_m > 1"))
    own = lookup(ranked, held.select("s", F.col("_m").alias("_n"), blocks.alias("_b")), ["s"], "_n").withColumn("_i", F.pmod(F.xxhash64("c1"), F.col("_b")).cast("int"))
    own = materialize(own)
    every = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_o")
    x = own.select("s", "c1", "n", "_i", every).select("s", F.col("c1").alias("a"), F.col("n").alias("_na"), F.col("_i").alias("_x"), F.col("_o").alias("_y"))
    y = own.select("s", "c1", "n", "_i", every).select("s", F.col("c1").alias("b"), F.col("n").alias("_nb"), F.col("_o").alias("_x"), F.col("_i").alias("_y"))
    return x.join(y, ["s", "_x", "_y"]).where("a < b").where(F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb")).select("a", "b").distinct()


def near_duplicates(
    records: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, least: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and pairs of classes (a, b, similarity) whose similarity reaches ``threshold``.

    Similarity is the number of distinct runs of ``width`` words found in both records, divided by the
    number found in either; words are the longest runs of letters or digits of the lower-cased text.
    Records of fewer than ``least`` words are left aside, as are null texts and null ids. Records with
    the same set of shingles are one class, named by its least id; pairs are between classes, a < b, and
    are not expanded to the copies. Repeated rows count once; whole texts are compared. An empty table
    gives empty results.
    """
    if least < width:
        raise ValueError("least must be at least width")
    spark = records.sparkSession
    rec = records.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = materialize(sketches(balanced(rec), width, least))
    ids = rows.where("id is not null")
    classes = materialize(ids.groupBy("c1", "c2", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("_n")))
    n_records = classes.agg(F.sum("_n")).first()[0] or 0
    hot = materialize(
        rows.where("id is null").groupBy(F.col("c1").alias("key")).agg(F.sum("c2").alias("k")).where(F.col("k") * HOT_KEYS > n_records).where(F.col("k") > BUCKET).select("key")
    )  # at most WINDOWS * 18 * HOT_KEYS keys
    flat = ids.where("keys is not null").select(F.explode("keys").alias("key"), "c1", "n")
    met = materialize(
        flat.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key", "c1").mapInPandas(_meetings(threshold, BUCKET), "a long, b long")
    )
    crowded = materialize(
        met.where("b is null").select(F.col("a").alias("c1")).unionByName(flat.join(F.broadcast(hot), "key").select("c1")).distinct()
    )
    pairs = met.where("b is not null").distinct()
    if not crowded.isEmpty():
        some = materialize(classes.join(crowded, "c1").select(F.col("class_id").alias("id"), "c1", "c2"))
        pairs = pairs.unionByName(_prefix_pairs(shingle_sets(rec, some, width), threshold)).distinct()
    pairs = materialize(pairs)
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("c1")).groupBy("c1").agg(F.count("*").alias("_n")))
    some = materialize(classes.drop("_n").join(involved.select("c1"), "c1").select(F.col("class_id").alias("id"), "c1", "c2"))
    sets = materialize(shingle_sets(rec, some, width).select("c1", "id", "shingles"))
    both = F.size(F.array_intersect("x", "y"))
    # the sets of a class with very many partners are copied to several tasks, so that no task has all of its pairs
    one = spread(pairs, sets.select(F.col("c1").alias("a"), F.col("id").alias("a_id"), F.col("shingles").alias("x")), "a", involved.withColumnRenamed("c1", "a"), "b")
    two = spread(one, sets.select(F.col("c1").alias("b"), F.col("id").alias("b_id"), F.col("shingles").alias("y")), "b", involved.withColumnRenamed("c1", "b"), "a")
    verified = (
        two.select("a_id", "b_id", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
        .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")
        .distinct()
    )
    named = lookup(ids.select("id", "c1", "c2", "n"), classes, ["c1", "c2", "n"], "_n")
    return named.select("id", "class_id").distinct(), verified


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of records (a_id < b_id): those of one class and those of classes that form a pair."""
    members, pairs = materialize(members), materialize(pairs.select("a", "b"))
    x = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    across = pairs.join(x, "a").join(y, "b").where("x <> y").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct()
