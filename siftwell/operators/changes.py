"""Incremental processing: what changed between two states, what has to be embedded anew, ranges of changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """key, state: ``added``, ``modified``, ``unchanged`` or ``deleted`` between two snapshots (key, hash) of unique keys."""
    o = old.select(key, F.col(hash_).alias("_o"), F.lit(True).alias("_x"))
    n = new.select(key, F.col(hash_).alias("_n"), F.lit(True).alias("_y"))
    state = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("modified")
    return o.join(n, key, "full").select(key, state.alias("state"))


def to_embed(entities: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Entities (id, entity_hash) without a vector of the model that carries their hash."""
    have = vectors.where(F.col("model_id") == model).select(F.col("entity_id").alias("id"), F.col("content_hash").alias("entity_hash")).distinct()
    return entities.join(have, ["id", "entity_hash"], "left_anti").select(*entities.columns)


def merge_ranges(df: DataFrame, by: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Union of line ranges per ``by``; ranges at most ``gap`` apart become one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w))
    return x.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def retry_batches(df: DataFrame, size: int) -> DataFrame:
    """Adds batch: rows in batches of about ``size``, by hash of all their columns, so that it survives a rerun."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int"))
