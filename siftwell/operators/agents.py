"""Checkpoints of agent plans, and how a plan goes on from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.entities import keep_latest
from siftwell.runtime import materialize

#: Fixed value: checkpoints kept per session.
KEPT = 10


def save(checkpoints: DataFrame, new: DataFrame, keep: int = KEPT) -> DataFrame:
    """Checkpoints with new ones (without step_number), numbered on in the order of created_at and id; the latest ``keep`` of each session stay."""
    last = checkpoints.groupBy("session_id").agg(F.max("step_number").alias("_m"))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    numbered = new.drop("step_number").join(last, "session_id", "left").withColumn("step_number", (F.coalesce("_m", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_m")
    return keep_latest(checkpoints.unionByName(numbered.select(*checkpoints.columns)), "session_id", [F.col("step_number").desc(), F.col("created_at").desc(), F.col("id")], keep)


def latest(checkpoints: DataFrame, step: int | None = None) -> DataFrame:
    """The last checkpoint of each session, or the last at a step."""
    x = checkpoints if step is None else checkpoints.where(F.col("step_number") == step)
    return keep_latest(x, "session_id", [F.col("step_number").desc(), F.col("created_at").desc(), F.col("id")], 1)


def ready(steps: DataFrame) -> DataFrame:
    """Adds next to plan steps (plan_id, id, status pending/done/failed/skipped, dependencies): ``run`` if all dependencies are done, ``skip`` if
    one failed or was skipped, however far back, ``wait`` else; null for steps that are not pending."""
    status = {"pending", "done"}  # what does not doom what depends on it
    now = steps.withColumn("doomed", ~F.col("status").isin(*status))
    need = materialize(steps.where("status = 'pending'").select("plan_id", "id", F.explode("dependencies").alias("dep")))
    while True:
        now = materialize(now)
        bad = need.join(now.where("doomed").select("plan_id", F.col("id").alias("dep")), ["plan_id", "dep"]).select("plan_id", "id").distinct()
        fresh = materialize(bad.join(now.where("doomed").select("plan_id", "id"), ["plan_id", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        now = now.join(fresh.withColumn("_f", F.lit(True)), ["plan_id", "id"], "left").withColumn("doomed", F.col("doomed") | F.coalesce("_f", F.lit(False))).drop("_f")
    open_ = need.join(steps.select("plan_id", F.col("id").alias("dep"), F.col("status").alias("s")), ["plan_id", "dep"], "left").where("s is null or s <> 'done'").select("plan_id", "id").distinct().withColumn("_w", F.lit(True))
    x = now.join(open_, ["plan_id", "id"], "left")
    return x.withColumn("next", F.when(F.col("status") != "pending", F.lit(None)).when(F.col("doomed"), "skip").when(F.col("_w"), "wait").otherwise("run")).select(*steps.columns, "next")
