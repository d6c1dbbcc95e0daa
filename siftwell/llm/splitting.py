"""Splitting long texts at natural boundaries by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundary, coarsest first; each pattern ends where the text may be cut (fixed values of the problem's statement).
KINDS = {
    "paragraph": re.compile(r"^(?:[ \t\r\f]*\n)+(?:[ \t\r\f]+\Z)?", re.M),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"[.!?][ \t\r\n\f]|。"),
    "word": re.compile(r"[ \t\r\n\f]"),
}


class Successors:
    """Farthest legal successor of every place of every text: at most ``core`` characters on, and the next place where there is none so near."""

    def __init__(self, places: list[np.ndarray], core: int) -> None:
        sizes = np.array([len(p) for p in places], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(places)), sizes)
        self.flat = np.concatenate([*places, np.zeros(0, np.int64)])
        stride = int(self.flat.max(initial=0)) + core + 1  # keeps the texts apart on one number line
        line = self.flat + owner * stride
        here = np.arange(len(line))
        self.last = np.repeat(self.first + sizes - 1, sizes)
        far = np.searchsorted(line, line + core, side="right") - 1
        #: Places that have no legal successor; a text is cut legally where none of its places is stuck.
        self.stuck = (far == here) & (here < self.last)
        self.next = np.minimum(np.maximum(far, here + 1), self.last)
        self.sizes = sizes

    def legal(self) -> np.ndarray:
        """For each text, whether all its places have a legal successor."""
        return np.add.reduceat(self.stuck, self.first) == 0 if len(self.sizes) else np.zeros(0, bool)

    def cuts(self) -> list[np.ndarray]:
        """For each text the greedy cuts, the first and last place included.

        Squaring the successor table doubles the step, and from the largest step down to one every marked place
        marks its successor, so that all cuts of all texts are found in parallel in log2(places) rounds.
        """
        if not len(self.flat):
            return [self.flat for _ in self.sizes]
        tables = [self.next]
        while (tables[-1] != self.last).any():
            tables.append(tables[-1][tables[-1]])
        marked = np.zeros(len(self.flat), dtype=bool)
        marked[self.first] = True
        for table in reversed(tables):
            marked[table[marked]] = True
        marked[self.last] = True
        return np.split(self.flat[marked], np.cumsum(np.add.reduceat(marked, self.first, dtype=np.int64))[:-1])


def cut(texts: list[str], core: int) -> list[tuple[str, np.ndarray]]:
    """Kind of boundary and greedy cuts of each text.

    Kind after kind, the places of a kind join those of the kinds before, until every place of the text has a legal
    successor. A text that has stuck places with all kinds is cut every ``core`` characters there (``none``).
    """
    out: list = [None] * len(texts)
    places = [np.array([0, len(t)], dtype=np.int64) for t in texts]
    open_ = list(range(len(texts)))
    for kind, pattern in KINDS.items():
        for i in open_:
            places[i] = np.union1d(places[i], np.fromiter((m.end() for m in pattern.finditer(texts[i])), dtype=np.int64))
        table = Successors([places[i] for i in open_], core)
        for i, ok, c in zip(open_, table.legal(), table.cuts()):
            if ok:
                out[i] = (kind, c)
        open_ = [i for i in open_ if out[i] is None]
    for i in open_:
        at = places[i]
        places[i] = np.union1d(at, np.concatenate([np.arange(a, b, core) for a, b in zip(at[:-1], at[1:])]))
    for i, c in zip(open_, Successors([places[i] for i in open_], core).cuts()):
        out[i] = ("none", c)
    return out


def split(
    df: DataFrame,
    key: str,
    text: str,
    limit: int = 3000,
    overlap: int = 200,
    line: str | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of at most ``limit`` characters, each beginning ``overlap`` characters before the end of the one before.

    Columns: key, chunk_index, char_start, char_end, boundary, start_line (null without ``line`` or
    where it is null) and, if asked, piece. A text within the limit is one piece of boundary
    ``whole``; a null or empty text has none. Repeated rows of a key count once in the result if they
    are equal. Texts are handled where they lie; nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    core = limit - overlap
    dtype = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {dtype}, chunk_index int, char_start int, char_end int, boundary string, start_line int" + ", piece string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nth = iter(cut([t for t in b["_text"] if len(t) > limit], core))
            rows = []
            for k, t, ln in zip(b["_key"], b["_text"], b["_line"]):
                kind, c = next(nth) if len(t) > limit else ("whole", (0, len(t)))
                for i, (a, e) in enumerate(zip(c[:-1], c[1:])):
                    a = int(max(0, a - overlap)) if i else 0
                    at = None if ln is None or ln != ln else int(ln) + t.count("\n", 0, a)
                    rows.append((k, i, a, int(e), kind, at, t[a:e])[: 6 + with_text])
            names = [key, "chunk_index", "char_start", "char_end", "boundary", "start_line", "piece"][: 6 + with_text]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "Int32"})

    rows = df.where(F.length(text) > 0).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(line) if line else F.lit(None)).cast("int").alias("_line")
    )
    return rows.mapInPandas(run, schema)


def boundary_kinds(df: DataFrame, key: str, text: str, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """Kind of boundary at which each text over the limit is cut."""
    long = df.where(F.length(text) > limit)
    return split(long, key, text, limit, overlap, with_text=False).where("chunk_index = 0").select(key, "boundary")
