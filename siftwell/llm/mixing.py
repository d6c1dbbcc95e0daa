"""Mixing sources to target shares by pivotal dependent rounding."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import tokens
from siftwell.runtime import materialize

#: Fractions that one node of the reduction tree combines, on average.
FAN_IN = 4096
_MASK = (1 << 64) - 1


def chance(key: int, seed: int, salt: int = 0) -> float:
    """A number in [0, 1) that depends on its arguments alone (splitmix64)."""
    z = (int(key) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + salt * 0x8CB92BA72F3D8DD7 + 0x632BE59BD9B4E019) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


class Pivot:
    """Rounds fractions one after the other. Two fractions are paired and mass is moved between them until one is
    0 or 1, by chance and so that every expectation and the sum of size times fraction stay as they are."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self.held: tuple | None = None  # (row, size, fraction) still undecided

    def add(self, row: tuple, size: int, fraction: float) -> list[tuple[tuple, int]]:
        """Take one more; return the rows decided, with 0 or 1."""
        if size == 0 or fraction <= 0 or fraction >= 1:
            return [(row, int(chance(row[0], self.seed, 1) < fraction))]
        if self.held is None:
            self.held = (row, size, fraction)
            return []
        other, size2, fraction2 = self.held
        up = min((1 - fraction) * size, fraction2 * size2)  # from the one held to the new one
        down = min(fraction * size, (1 - fraction2) * size2)
        if chance(row[0], self.seed, 2) * (up + down) < down:
            fraction, fraction2 = fraction + up / size, fraction2 - up / size2
        else:
            fraction, fraction2 = fraction - down / size, fraction2 + down / size2
        near = 1e-9
        out, left = [], []
        for r, s, f in ((other, size2, fraction2), (row, size, fraction)):
            if f < near or f > 1 - near:
                out.append((r, int(f > 0.5)))
            else:
                left.append((r, s, f))
        self.held = left[0] if left else None
        return out


def plan(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, dict]:
    """Copies wanted of each text, per source: {source: share, copies}.

    Shares of sources without tokens go to the others in proportion. ``total`` tokens are mixed; by
    default as many as there can be with every share met. A source that can't reach its share of a
    given total is used as often as its cap allows.
    """
    usable = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and available.get(s, 0) > 0]
    whole = sum(share for _, share, _ in usable)
    out = {s: {"share": 0.0, "copies": 0.0} for s, _, _ in targets}
    if not usable:
        return out
    if total is None:
        total = min(available[s] * cap / (share / whole) for s, share, cap in usable)
    for s, share, cap in usable:
        f = min(cap, total * share / whole / available[s])
        f = float(round(f)) if abs(f - round(f)) < 1e-9 else f
        out[s] = {"share": share / whole, "copies": f}
    return out


def mix(
    df: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 1, vocabulary: str = tokens.VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """Use count of every document, and the shares reached.

    ``key`` is a unique whole number, ``targets`` (source, target_share, max_repeats) a table small
    enough to be read by the driver. First result: key, source, n_tokens, copies; documents of no
    target source or with a null text have 0 copies. Second: source, target_share, wanted_share (of
    the sources that have tokens), max_repeats, available_tokens, mixed_tokens, actual_share.

    Fractions are dealt by the hash of their key to nodes of about FAN_IN and rounded there in the order of size and key;
    each node is left with at most one, and these are combined in a tree. So no source is gathered in one task, each
    share is off by less than one document, and the outcome depends on the rows alone, not on how they are partitioned.
    """
    sized = materialize(tokens.sizes(df, key, text, keep=(source,), vocabulary=vocabulary))
    goals = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).collect() if r[0] is not None]
    names = [g[0] for g in goals]
    sums = sized.where(F.col(source).isin(names)).groupBy(source).agg(F.sum("n_tokens")).collect() if names else []
    available = {r[0]: int(r[1] or 0) for r in sums}
    wanted = {s: p["copies"] for s, p in plan(goals, available, total).items()}
    dtype = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {dtype}, `{source}` string, n_tokens long, copies int, fraction double"
    cols = [key, source, "n_tokens", "copies", "fraction"]

    def combine(b: pd.DataFrame) -> pd.DataFrame:
        pivot, rows = Pivot(seed), []
        b = b.sort_values(["n_tokens", key], ascending=False)  # so that what is left over tends to be small
        for k, s, n, c, f in zip(b[key], b[source], b["n_tokens"], b["copies"], b["fraction"]):
            rows += [(*r[:3], r[3] + one, 0.0) for r, one in pivot.add((k, s, int(n), int(c)), int(n), f)]
        if pivot.held:
            rows.append((*pivot.held[0], pivot.held[2]))
        return pd.DataFrame(rows, columns=cols)

    base = F.create_map(*[F.lit(x) for s, f in wanted.items() for x in (s, f)])[F.col(source)] if wanted else F.lit(0.0)
    size = F.col("n_tokens").isNotNull()
    whole = F.when(size, F.coalesce(F.floor(base), F.lit(0))).otherwise(0)
    start = sized.withColumn("copies", whole.cast("int")).withColumn("fraction", F.when(size, F.coalesce(base - F.floor(base), F.lit(0.0))).otherwise(0.0))
    done = start.where("fraction = 0").select(cols)
    left, level = start.where("fraction > 0").select(cols), 0
    counts = {r[0]: r[1] for r in left.groupBy(source).count().collect()}
    while max(counts.values(), default=0) > 1:
        nodes = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, math.ceil(n / FAN_IN))])[F.col(source)]
        node = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), key), nodes)
        stage = materialize(left.groupBy(F.col(source).alias("_s"), node.alias("_n")).applyInPandas(combine, schema))
        done = done.unionByName(stage.where("fraction = 0"))
        left, level = stage.where("fraction > 0"), level + 1
        counts = {r[0]: r[1] for r in left.groupBy(source).count().collect()}
    # at most one fraction per source is left
    last = [(r[key], r["copies"] + int(chance(r[key], seed, 3) < r["fraction"])) for r in left.collect()]
    settled = F.lit(None).cast("int")
    for k, n in last:
        settled = F.when(F.col(key) == k, n).otherwise(settled)
    uses = done.unionByName(left.withColumn("copies", settled)).drop("fraction")
    shares = plan(goals, available, total)
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(s, t, shares[s]["share"], m, available.get(s, 0)) for s, t, m in goals],
        "source string, target_share double, wanted_share double, max_repeats int, available_tokens long",
    )
    used = uses.where("copies > 0").groupBy(F.col(source).alias("source")).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    all_used = used.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        known.join(used, "source", "left")
        .join(F.broadcast(all_used))
        .select(*known.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
    return uses, report
