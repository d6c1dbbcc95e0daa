"""Filling containers of fixed capacity with neighbouring texts along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import tokens
from siftwell.runtime import materialize

#: Texts that are packed together, and containers left open for the texts that follow along the curve.
WINDOW, OPEN = 4096, 512
#: Texts of one stretch of the curve, on average; cells of the curve that stretches are made of (2 to the power of CELLS).
STRETCH, CELLS = 32_768, 15


class Packer:
    """Containers of one capacity. Within a window of neighbouring texts the largest come first, each into the
    open container with the least room that holds it."""

    def __init__(self, name: str, capacity: int, prefix: str) -> None:
        self.name, self.capacity, self.prefix = name, capacity, prefix
        self.room: list[tuple[int, int]] = []  # (room, number of the container), sorted
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def pack(self, docs: list[tuple[int, int]]) -> list[tuple]:
        rows, rest = [], []
        for doc, n in docs:
            whole, part = divmod(n, self.capacity)
            if n and not part:
                whole, part = whole - 1, self.capacity
            rows += [(self.name, doc, i, i * self.capacity, (i + 1) * self.capacity, self.new()) for i in range(whole)]
            rest.append((part, doc, whole))
        for n, doc, piece in sorted(rest, reverse=True):
            i = bisect_left(self.room, (n, -1))
            if i < len(self.room):
                room, box = self.room.pop(i)
            else:
                room, box = self.capacity, self.new()
            if room > n:
                insort(self.room, (room - n, box))
            start = piece * self.capacity
            rows.append((self.name, doc, piece, start, start + n, box))
        self.room = self.room[-OPEN:]
        return rows


def pack(df: DataFrame, key: str, text: str, limits: list[tuple[str, int]], vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Container of every text, or piece of a text, for each limit (name, capacity in tokens).

    Columns: limit_name, key, piece, token_start, token_end, n_tokens, container_id. Only texts over
    the capacity are split, into pieces of exactly the capacity and a rest. An empty text takes no
    room in a container; a null text gets one row per limit with nulls. Keys must be unique: a repeated
    row is packed as often as it comes. The sizes are computed once and written. The curve is cut into stretches of
    about STRETCH texts, by counts per cell of the curve; a cell that holds more is dealt by the hash of the key. Each
    stretch is packed by itself in the order of curve and key, so that the outcome depends on the rows alone.
    """
    if any(c < 1 for _, c in limits):
        raise ValueError("capacities must be positive")
    bits = 12
    sized = materialize(tokens.sizes(df, key, text, vocabulary=vocabulary, dims=3, bits=bits))
    dtype = df.schema[key].dataType.simpleString()
    schema = f"limit_name string, `{key}` {dtype}, piece int, token_start long, token_end long, container_id string"
    names = ["limit_name", key, "piece", "token_start", "token_end", "container_id"]

    def run(where: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["curve", key])
        docs = list(zip(b[key], b["n_tokens"]))
        out = []
        for name, cap in limits:
            packer = Packer(name, cap, f"{name}-{where[0]}-{where[1]}-")
            for i in range(0, len(docs), WINDOW):
                out += [(*r[:5], f"{packer.prefix}{r[5]}") for r in packer.pack(docs[i : i + WINDOW])]
        return pd.DataFrame(out, columns=names)

    cell = F.shiftright("curve", 3 * bits - CELLS).cast("int")
    texts = sized.where("n_tokens is not null").select(key, "n_tokens", "curve", cell.alias("cell"))
    # one row per cell, 2 ** CELLS at most
    plan, held, stretch = [], 0, 0
    for c, n in sorted(tuple(r) for r in texts.groupBy("cell").count().collect()):
        if held and held + n > STRETCH:
            held, stretch = 0, stretch + 1
        plan.append((c, stretch, -(-n // STRETCH)))
        held += n
    cut = df.sparkSession.createDataFrame(plan, "cell int, stretch int, parts int")
    part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    packed = texts.join(F.broadcast(cut), "cell").groupBy("stretch", part.alias("part")).applyInPandas(run, schema)
    names_col = F.explode(F.array(*[F.lit(n) for n, _ in limits])) if limits else F.lit(None).cast("string")
    none = sized.where("n_tokens is null").select(
        names_col.alias("limit_name"),
        key,
        *[F.lit(None).cast(t).alias(c) for c, t in (("piece", "int"), ("token_start", "long"), ("token_end", "long"), ("container_id", "string"))],
    )
    return packed.unionByName(none).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))


def fill(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Containers, tokens and share of the room used, per limit."""
    capacity = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("limit_name")]
    boxes = packed.where("container_id is not null").groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    return boxes.groupBy("limit_name").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), (F.sum("n") / F.sum(capacity)).alias("fill"), F.max("n").alias("fullest")
    )
