"""Sizes of texts in tokens of a public byte-pair tokenizer, and hashed document vectors."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.runtime import balanced

#: Vocabulary file (ranks of a byte-level BPE); never copied, only read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that splits texts before the merges of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets of the hashed document vectors.
BUCKETS = 4096


class Sizer:
    def __init__(self, vocabulary: str, dims: int) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        bucket = (np.arange(max(ranks.values()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS)
        self.axes = np.random.default_rng(7).standard_normal((BUCKETS, dims))[bucket.astype(np.int64)] if dims else None

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each text; with dims also its token counts over hashed buckets, projected to them and
        scaled by the root of the number of tokens."""
        ids = [self.encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        if self.axes is None:
            return n, None
        out = np.stack([self.axes[i].sum(axis=0) for i in ids]) if ids else np.zeros((0, self.axes.shape[1]))
        return n, out / np.sqrt(np.maximum(1, n))[:, None]


@functools.lru_cache(maxsize=4)
def sizer(vocabulary: str, dims: int) -> Sizer:
    return Sizer(vocabulary, dims)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below 2**bits (Skilling, 2004)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sizes(
    df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY, dims: int = 0, bits: int = 12
) -> DataFrame:
    """key, ``keep``, n_tokens (null for a null text) and, with ``dims``, curve: the place of the text's
    hashed word vector, projected to ``dims`` dimensions, along the Hilbert curve."""
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    schema = ", ".join([*fields, "n_tokens long"] + ["curve long"] * bool(dims))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sizer(vocabulary, dims)
        for b in batches:
            texts = b.pop("_text")
            n, v = s.measure([t or "" for t in texts])
            b["n_tokens"] = pd.array(np.where(texts.isna(), 0, n), dtype="Int64")
            b.loc[texts.isna().to_numpy(), "n_tokens"] = pd.NA
            if dims:
                side = (1 << bits) - 1
                b["curve"] = hilbert((side / (1 + np.exp(-v))).astype(np.int64), bits)
            yield b

    return balanced(df.select(key, *keep, F.col(text).alias("_text"))).mapInPandas(run, schema)
