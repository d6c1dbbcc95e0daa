"""Orphan references from signed reference and existence counts.

A change feed is a DataFrame of deltas per key: how many references to the key appeared
(+) or went (-), how many records with that key appeared or went, and how many removals
were logged. Counts add up, so a state is maintained by adding new deltas to it, in any
order; keys with positive references and zero existence are the current orphans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.runtime import materialize

#: A key that holds more than 1/HOT of all references is hot; there are fewer than HOT such keys.
HOT = 200


def deltas(
    df: DataFrame,
    key: Column,
    references: Column | int = 0,
    existence: Column | int = 0,
    removals: Column | int = 0,
    born: Column | None = None,
    referred: Column | None = None,
) -> DataFrame:
    """Change rows of ``df`` as deltas; rows with a null key are no reference and are left out."""

    def n(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("long")

    none = F.lit(None).cast("timestamp")
    return df.select(
        key.alias("key"),
        n(references).alias("refs"),
        n(existence).alias("existing"),
        n(removals).alias("removed"),
        (none if born is None else born).alias("born"),
        (none if referred is None else referred).alias("first_ref"),
    ).where(F.col("key").isNotNull())


def accumulate(*parts: DataFrame) -> DataFrame:
    """Add up deltas (or a former state and new deltas) to one row per key.

    The sums are pre-aggregated before the shuffle, so a hot key costs one row per task.
    ``born`` and ``first_ref`` keep the earliest time.
    """
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("key")
        .agg(
            F.sum("refs").alias("refs"),
            F.sum("existing").alias("existing"),
            F.sum("removed").alias("removed"),
            F.min("born").alias("born"),
            F.min("first_ref").alias("first_ref"),
        )
    )


def advance(state: DataFrame | None, *changes: DataFrame) -> DataFrame:
    """The stored state after more deltas: what is kept between runs, one row per key, keys without any count left out.

    Deltas may come in any order and any number of rounds; the state costs one shuffle of its own size a round.
    """
    parts = changes if state is None else (state, *changes)
    return materialize(accumulate(*parts).where("refs <> 0 or existing <> 0 or removed <> 0"))


def orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence; kind ``deleted`` if a removal was logged, else ``missing``."""
    return state.where((F.col("refs") > 0) & (F.col("existing") <= 0)).withColumn(
        "kind", F.when(F.col("removed") > 0, "deleted").otherwise("missing")
    )


def report(references: DataFrame, entities: DataFrame, removals: DataFrame) -> DataFrame:
    """Every reference that leads nowhere, or led nowhere when it was made.

    ``references``: ref_table, ref_field, row_key, key, at. ``entities``: key, at. ``removals``: key.
    Returns distinct rows ref_table, ref_field, row_key, kind, period. Null keys are no
    reference; repeated rows count once; a null ``at`` gives a null period and is never late.
    An empty table gives an empty share. Keys are compared exactly as written.

    Only the rows of suspect keys are shuffled by key. Keys with more than 1/200 of all
    references (fewer than 200, whatever the data) never are: they are joined by broadcast.
    """
    references = references.select("ref_table", "ref_field", "row_key", "key", "at").where(F.col("key").isNotNull())
    known = entities.groupBy("key").agg(F.min("at").alias("at"))
    gone = removals.select("key").distinct()
    # existence and removals are one round of changes, references the next, added to the state that the first has left
    state = advance(None, deltas(known, F.col("key"), existence=1, born=F.col("at")), deltas(gone, F.col("key"), removals=1))
    state = advance(state, deltas(references, F.col("key"), references=1, referred=F.col("at"))).where(F.col("refs") > 0)
    total = state.agg(F.sum("refs")).first()[0] or 0
    suspects = orphans(state).unionByName(
        state.where((F.col("existing") > 0) & (F.col("born") > F.col("first_ref"))).withColumn("kind", F.lit("late"))
    ).select("key", "kind", "born", "refs")
    is_hot = F.col("refs") * HOT > total
    hot = [r.key for r in state.where(is_hot).select("key").collect()]  # fewer than HOT rows
    cold = references.where(~F.col("key").isin(hot)) if hot else references
    joined = cold.join(suspects.where(~is_hot), "key")
    if hot:
        joined = joined.unionByName(references.join(F.broadcast(suspects.where(is_hot)), "key"))
    return (
        joined.where((F.col("kind") != "late") | (F.col("born") > F.col("at")))
        .select("ref_table", "ref_field", "row_key", "kind", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def counts(found: DataFrame) -> DataFrame:
    """Number of reported references per table, field, kind and month."""
    return found.groupBy("ref_table", "ref_field", "kind", "period").agg(F.count("*").alias("n_references"))
