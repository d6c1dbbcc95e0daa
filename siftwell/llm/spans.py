"""Long exact spans that documents share, by anchors at fixed-size blocks.

A stretch of the least length holds many blocks of half that length. The one of least hash is its anchor: both
sides choose it by content, so that a stretch and its repeat have the same one wherever they lie. The index holds
only the blocks that are the anchor of some stretch, about one for every 50 characters whatever the size of the
corpus; every rolling window of a block's size takes part in the choice and so probes the index, but only
the chosen ones are shuffled. A block found as an anchor in two different texts is a hit. Hits are extended to the maximal repeats by
comparing the stretches of which the block is the anchor, each by its own 64 bits next to the 64 bits of its
anchor, without ever pairing documents. Only texts that hold a hit are read again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.joins import lookup
from siftwell.runtime import balanced, materialize

#: Characters hashed at once, and the largest filter of keys in bits (64 MB). A fuller filter lets more keys pass; the result stays the same.
STRIP, MOST_BITS = 1 << 20, 1 << 29
#: Multipliers of the rolling hashes (any odd numbers).
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@functools.lru_cache(maxsize=4)
def _powers(seed: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, seed, dtype=np.uint64)]))


class Strip:
    """Stretches of texts laid end to end: owner and offset of each, code points, and rolling hashes over them."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]]) -> None:
        self.owner = np.array([p[0] for p in parts], dtype=np.int64)
        self.offset = np.array([p[1] for p in parts], dtype=np.int64)
        self.length = np.array([len(p[2]) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        c = np.concatenate([p[2] for p in parts]).astype(np.uint64)
        c = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.chars = c ^ (c >> np.uint64(29))
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, at: np.ndarray | slice, width: int, seed: int = _SEEDS[0]) -> np.ndarray:
        """Hash of the ``width`` characters from each place on."""
        n = len(self.chars)
        top = 2 * STRIP  # the same for every strip, and more than any strip has
        power = _powers(seed, top)
        if seed not in self.sums:
            self.sums[seed] = np.concatenate([[np.uint64(0)], np.cumsum(self.chars * power[:n])])
        s = self.sums[seed]
        if isinstance(at, slice):
            x = (s[width:] - s[: n - width + 1]) * power[top - n + width : top + 1][::-1]
        else:
            x = (s[at + width] - s[at]) * power[top - at]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def anchors(self, block: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all stretches of ``width`` that lie within one text, and for each the place of its block of least hash (the first of equals)."""
        n = width - block + 1
        starts = np.flatnonzero(self.valid(width))
        if not len(starts):
            return starts, starts
        h = self.hashes(slice(None), block)
        low = np.uint64(22)  # a strip has fewer than 2**22 places
        v = (h >> low) << low | np.arange(len(h), dtype=np.uint64)
        # least value of every n in a row: the end of one stretch of n numbers and the beginning of the next
        rows = np.concatenate([v, np.full(-len(v) % n, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, n)
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(rows, axis=1).ravel()
        least = np.minimum(after[starts], before[starts + n - 1])
        return starts, (least & np.uint64((1 << 22) - 1)).astype(np.int64)

    def valid(self, width: int) -> np.ndarray:
        """True where a window of ``width`` lies within one stretch."""
        n = len(self.chars) - width + 1
        ok = np.ones(max(0, n), dtype=bool)
        for s, ln in zip(self.start, self.length):
            ok[max(s, s + ln - width + 1) : s + ln] = False
        return ok


def strips(texts: list[str], width: int) -> Iterator[Strip]:
    """All texts in strips of about STRIP characters; longer texts are cut with ``width`` - 1 characters in common."""
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0
    for i, t in enumerate(texts):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for a in range(0, max(1, len(code) - width + 1), STRIP):
            piece = code[a : a + STRIP + width - 1]
            if held and held + len(piece) > STRIP:
                yield Strip(parts)
                parts, held = [], 0
            parts.append((i, a, piece))
            held += len(piece)
    if parts:
        yield Strip(parts)


class Filter:
    """Set of 64-bit hashes with false positives: four bits of one 64-bit word each, 32 bits or more per hash up to the bound."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def bits(n_hashes: int) -> int:
        return min(MOST_BITS, max(1 << 12, 1 << int(np.ceil(np.log2(32 * max(1, n_hashes))))))

    @staticmethod
    def place(h: np.ndarray, n_words: int) -> np.ndarray:
        return (h >> np.uint64(64 - int(np.log2(n_words)))).astype(np.int64)

    @staticmethod
    def mask(h: np.ndarray) -> np.ndarray:
        m = np.zeros(len(h), dtype=np.uint64)
        for k in range(4):
            m |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return m

    def has(self, h: np.ndarray) -> np.ndarray:
        w = self.words[self.place(h, len(self.words))]
        hit = (w >> (h & np.uint64(63))) & np.uint64(1) != 0
        at = np.flatnonzero(hit)  # one of the four bits settles most
        m = self.mask(h[at])
        hit[at] = (w[at] & m) == m
        return hit

    @classmethod
    def build(cls, hashes: DataFrame, n_hashes: int) -> Filter:
        """Filter of a column ``h``; its words are combined on the executors, and no more than MOST_BITS reach the driver."""
        n_words = cls.bits(n_hashes) // 64

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                h = b["h"].to_numpy().view(np.uint64)
                if not len(h):
                    continue
                w, m = cls.place(h, n_words), cls.mask(h)
                o = np.argsort(w, kind="stable")
                w, m = w[o], m[o]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                yield pd.DataFrame({"w": w[first].astype(np.int32), "m": np.bitwise_or.reduceat(m, first).view(np.int64)})

        got = hashes.mapInPandas(run, "w int, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        words = np.zeros(n_words, dtype=np.uint64)
        words[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        return cls(words)


def _classes(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_c1"), F.xxhash64(F.lit(17), text).alias("_c2")]


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """key, span_start, span_end of every longest stretch of characters that lie in ``least`` characters found,
    exactly the same, in another document.

    Keys must be unique. Null texts and those shorter than ``least`` share nothing; repeats within one
    document do not count; texts are compared whole, by two 64-bit hashes over their code points (of the stretch and of its
    anchor). Documents with the same text are shared from end to end (if long enough) and otherwise count as one.
    A text that repeats one character has an anchor at each place. An empty table gives an empty result.

    Counts per hash are pre-aggregated before each shuffle, so a passage in a third of all documents is
    no hot spot. What is shuffled is a fixed share of the text, whatever the size of the corpus.
    """
    if not 2 <= least <= STRIP:
        raise ValueError(f"least must be between 2 and {STRIP}")
    spark = df.sparkSession
    block = least // 2
    name, key = key, "_key"
    docs = df.where(F.length(text) >= least).select(F.col(name).alias(key), F.col(text).alias("_text"), *_classes(F.col(text)))
    ktype = df.schema[name].dataType.simpleString()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cls, keys = b["_c1"].to_numpy(), b[key].to_numpy()
            for s in strips(b["_text"].tolist(), least):
                start, at = s.anchors(block, least)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
                n = np.diff(np.concatenate([first, [len(at)]]))
                start, at = start[first], at[first]
                own = np.searchsorted(s.start, start, side="right") - 1
                yield pd.DataFrame({"h": s.hashes(at, block).view(np.int64), "_c1": cls[s.owner[own]], key: keys[s.owner[own]], "at": (s.offset[own] + start - s.start[own]).astype(np.int32), "n": n.astype(np.int32)})

    # one row for each run of stretches with the same anchor: its first stretch and how many there are
    runs = materialize(balanced(docs.select(key, "_text", "_c1")).mapInPandas(choose, f"h long, _c1 long, `{key}` {ktype}, at int, n int"))
    hits = materialize(runs.groupBy("h").agg(F.min("_c1").alias("a"), F.max("_c1").alias("z"), F.count("*").alias("_n")).where("a <> z").select("h", "_n"))
    # the runs of one document, so never more than it has characters
    packed = F.flatten(F.collect_list(F.array(F.shiftleft(F.col("at").cast("long"), 32) + F.col("n"), F.col("h"))))
    places = materialize(lookup(runs, hits, ["h"], "_n").groupBy(key).agg(packed.alias("_runs")))

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(holders.value)
        for b in batches:
            yield b[known.has(b["h"].to_numpy().view(np.uint64))].drop(columns="h")

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cls, keys = b["_c1"].to_numpy(), b[key].to_numpy()
            flat = np.concatenate([*b["_runs"], np.zeros(0, np.int64)]).astype(np.int64).reshape(-1, 2)
            line = (np.repeat(np.arange(len(b)), [len(r) // 2 for r in b["_runs"]]) << 32) | (flat[:, 0] >> 32)
            order = np.argsort(line, kind="stable")
            line, n, anchor = line[order], flat[order, 0] & 0xFFFFFFFF, flat[order, 1]
            for s in strips(b["_text"].tolist(), least):
                lo = np.searchsorted(line, (s.owner << 32) | s.offset)
                hi = np.searchsorted(line, (s.owner << 32) | (s.offset + STRIP))
                r = np.repeat(lo, hi - lo) + _within(hi - lo)
                part = np.repeat(np.repeat(np.arange(len(lo)), hi - lo), n[r])
                at = np.repeat(line[r] & 0xFFFFFFFF, n[r]) + _within(n[r])
                h = s.hashes(at - s.offset[part] + s.start[part], least, _SEEDS[1]).view(np.int64)
                yield pd.DataFrame({"m": np.repeat(anchor[r], n[r]), "h": h, "_c1": cls[s.owner[part]], key: keys[s.owner[part]], "at": at.astype(np.int32)})

    holders = spark.sparkContext.broadcast(Filter.build(places.select(F.xxhash64(key).alias("h")), places.count()).words)
    held = docs.select(key, "_text", "_c1", F.xxhash64(key).alias("h")).mapInPandas(hold, f"`{key}` {ktype}, _text string, _c1 long")
    rows = materialize(held.join(places, key).mapInPandas(stretches, f"m long, h long, _c1 long, `{key}` {ktype}, at int"))
    common = materialize(
        rows.groupBy("m", "h").agg(F.min("_c1").alias("a"), F.max("_c1").alias("z"), F.count("*").alias("_n")).where("a <> z").select("m", "h", "_n")
    )
    parts = lookup(rows, common, ["m", "h"], "_n").select(key, F.col("at").alias("s"), (F.col("at") + least).alias("e"))
    names = docs.select(key, "_c1", "_c2", F.length("_text").alias("e"))
    copies = materialize(names.groupBy("_c1", "_c2").agg(F.count("*").alias("_n")).where("_n > 1"))
    whole = lookup(names, copies, ["_c1", "_c2"], "_n").select(key, F.lit(0).alias("s"), "e")
    return islands(parts.unionByName(whole), key).withColumnRenamed(key, name)


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def islands(intervals: DataFrame, key: str) -> DataFrame:
    """Union of the intervals [s, e) of each key; touching or overlapping ones become one."""
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("s", "e")
    flagged = intervals.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1))).cast("int"))
    return (
        flagged.withColumn("nth", F.sum("new").over(upto))
        .groupBy(key, "nth")
        .agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
        .select(key, "span_start", "span_end")
    )


def coverage(df: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """How much of each document is shared: key, n_chars, shared_chars, shared_share, n_spans. A null text has null shares."""
    per = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    n = F.length(text)
    return df.select(key, n.alias("n_chars")).join(per, key, "left").select(
        key,
        "n_chars",
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).when(F.col("n_chars") == 0, 0.0).alias("shared_share"),
    )
