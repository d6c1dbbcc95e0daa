"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.joins import lookup
from siftwell.runtime import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Join the neighbours of each node to its least neighbour: the larger ones (large star), or those not larger (small star)."""
    both = edges.where("u > v") if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = materialize(both.distinct())
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n")))
    joined = lookup(both, least, ["u"], "_n")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.where("u <> v").distinct())


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node that has an edge to another node.

    Edges are undirected; null ends, self-loops and repeated edges are of no account. The number of
    rounds grows with the logarithm of the number of nodes; hot nodes are joined by broadcast.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull()).toDF("u", "v", "ok").where("ok and u <> v").drop("ok").distinct())
    for _ in range(rounds):
        after = _star(_star(e, small=False), small=True)
        changed = after.exceptAll(e).limit(1).count() + e.exceptAll(after).limit(1).count()
        e = after
        if not changed:
            break
    else:
        raise RuntimeError("components: no fix point within the rounds allowed")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
