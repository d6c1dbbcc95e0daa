"""Joins that hold up under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT of the left rows is hot; there are fewer than HOT such keys.
HOT = 200


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and in ``weight`` how many left rows the key has.

    Keys with more than 1/200 of the weight (fewer than 200, whatever the data) are joined by
    broadcast, so that their left rows stay where they are; the others are shuffled. ``right``
    should be a stored table, as it is read twice. ``weight`` is not in the result.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT > total
    hot = right.where(is_hot).select(*keys)
    rows = hot.collect()  # fewer than HOT
    bounded = left.sparkSession.createDataFrame(rows, hot.schema).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(bounded), keys, "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right.where(~is_hot).drop(weight), keys)
    if not rows:
        return cold
    return cold.unionByName(left.join(F.broadcast(right.where(is_hot).drop(weight)), keys))


def spread(left: DataFrame, right: DataFrame, key: str, weights: DataFrame, by: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key``; for rows too large to be broadcast.

    ``weights``: key and in ``_n`` about how many left rows it has (a stored table). The right row of a key with more than
    1/200 of the weight is copied, and the left rows of the key are dealt to the copies by the hash of ``by``, so that
    no task gets all of them. There are fewer than 200 such keys and no more than 400 copies of rows in all.
    """
    total = weights.agg(F.sum("_n")).first()[0] or 0
    hot = weights.where(F.col("_n") * HOT > total).select(key, F.ceil(F.col("_n") * HOT / total).cast("int").alias("_c"))
    spark = left.sparkSession
    few = F.broadcast(spark.createDataFrame(hot.collect(), hot.schema))  # fewer than HOT rows
    copies = F.coalesce("_c", F.lit(1))
    dealt = left.join(few, key, "left").withColumn("_d", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_c")
    copied = right.join(few, key, "left").withColumn("_d", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_c")
    return dealt.join(copied, [key, "_d"]).drop("_d")
