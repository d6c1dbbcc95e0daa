"""Rebuilding ordered conversations from message rows.

Messages carry no parent ids, so every message's parent is the message before it in its
session. The rows are range-sorted over the whole table, which also splits a session that
holds a third of all rows; the pointers inside one sorted partition lead straight to the
head of the run of rows of one session, and the heads are resolved across partitions by
pointer-jumping joins (:func:`resolve_parents`), which also find orphans and cycles where
parents are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.runtime import is_blank, materialize, partitions, stripped

#: Spellings of speakers (fixed values of the problem's statement).
SPEAKERS = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "system": "system",
}


def resolve_parents(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node by pointer-jumping joins.

    ``nodes``: id (unique), parent (null for a root), weight (length of the step to the parent).
    Returns id, root, depth and status: ``ok``, ``orphan`` (the chain ends at a parent that is
    not there; root is then the last node that is) or ``cycle`` (root and depth are null).
    Each round doubles the length of every pointer, so chains of length n take log2(n) joins;
    nodes whose root is known take no further part on the left side. Rows with a null id are
    left out. An empty table gives an empty result.
    """
    nodes = nodes.where(F.col("id").isNotNull()).select("id", "parent", F.col("weight").cast("long").alias("weight"))
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    state = materialize(
        nodes.join(ids, "parent", "left").select(
            "id",
            F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("ptr"),
            F.when(F.col("there"), F.col("weight")).otherwise(F.lit(0).cast("long")).alias("depth"),
            F.when(F.col("parent").isNull(), "ok").when(F.col("there").isNull(), "orphan").alias("status"),
        )
    )
    done = state.where(F.col("status").isNotNull())
    active = state.where(F.col("status").isNull())
    left, rounds = active.count(), 0
    bound = max(1, state.count()).bit_length() + 1
    while left and rounds < bound:
        target = done.unionByName(active).select(
            F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2"), F.col("status").alias("status2")
        )
        step = materialize(
            active.join(target, "ptr").select(
                "id", F.col("ptr2").alias("ptr"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("status2").alias("status")
            )
        )
        done = done.unionByName(step.where(F.col("status").isNotNull()))
        active = step.where(F.col("status").isNull())
        left, rounds = active.count(), rounds + 1
    cyclic = active.select(
        "id", F.lit(None).cast(active.schema["ptr"].dataType).alias("ptr"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("status")
    )
    return done.unionByName(cyclic).select("id", F.col("ptr").alias("root"), "depth", "status")


def speaker(role: Column) -> Column:
    """user, assistant or system; null if the role is none of them."""
    r = F.lower(stripped(role))
    out = F.lit(None).cast("string")
    for spelling, name in SPEAKERS.items():
        out = F.when(r == spelling, name).otherwise(out)
    return out


def clean(messages: DataFrame) -> DataFrame:
    """Messages with a session and content, each once.

    Messages that agree in session_id, role, content and a non-null created_at count once with
    the lowest position; without created_at the id tells them apart.
    """
    m = messages.where(F.col("session_id").isNotNull() & ~is_blank(F.col("content")))
    no_time = F.when(F.col("created_at").isNull(), F.col("id")).alias("_id")
    return (
        m.groupBy("session_id", "role", "content", "created_at", no_time)
        .agg(F.min("position").alias("position"), F.min("id").alias("id"))
        .withColumn("speaker", speaker(F.col("role")))
    )


def thread(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every message with its place in its conversation: session_id, root, turn, speaker, created_at, ``keep``.

    Order is created_at, position, id, with null times last. ``turn`` counts from 0.
    """
    spark = messages.sparkSession
    order = [F.col("session_id"), F.col("created_at").asc_nulls_last(), F.col("position").asc_nulls_last(), F.col("id").asc_nulls_last()]
    cols = ["session_id", "speaker", "created_at", *keep]
    rows = materialize(
        messages.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select(F.monotonically_increasing_id().alias("idx"), *cols)
    )
    part = F.shiftright("idx", 33)
    runs = rows.groupBy("session_id", part.alias("part")).agg(F.min("idx").alias("id"), F.count("*").alias("n"))
    # at most one row for each pair of session and partition
    before = Window.partitionBy("session_id").orderBy("part")
    runs = materialize(
        runs.select("session_id", "part", "id", F.lag("id").over(before).alias("parent"), F.lag("n").over(before).alias("weight"))
    )
    heads = resolve_parents(runs).join(runs.select("id", F.col("part").alias("run_part"), F.col("session_id").alias("run_session")), "id")
    return (
        rows.join(heads, (F.col("session_id") == F.col("run_session")) & (part == F.col("run_part")))
        .select("root", (F.col("depth") + F.col("idx") - F.col("id")).alias("turn"), *cols)
    )


def branches(messages: DataFrame, parent: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Conversations of messages that name their parent in the column ``parent``: every path from a root to a leaf.

    ``messages``: id, speaker, created_at. First result: leaf, root, turn (from 0), id, speaker, created_at, ``keep``; a message
    with several replies is part of several paths. Second: id and status of the messages left out, ``orphan``
    (an ancestor is missing) or ``cycle``. Repeated rows of an id count once, rows without an id are left
    out, an empty parent is a root.

    A leaf of depth d is joined to its ancestors by the tables of 1, 2, 4, ... steps up, log2(depth) joins on rows of the result's size.
    """
    cols = ["id", "speaker", "created_at", *keep]
    m = materialize(messages.where(F.col("id").isNotNull()).select(*dict.fromkeys(cols), F.col(parent).alias("_parent")).dropDuplicates(["id"]))
    placed = materialize(resolve_parents(m.select("id", F.col("_parent").alias("parent"), F.lit(1).alias("weight"))))
    good = placed.where("status = 'ok'").select("id", "root", "depth")
    up = m.where(F.col("_parent").isNotNull()).select("id", F.col("_parent").alias("up")).join(good.select("id"), "id", "left_semi")
    leaves = good.join(up.select(F.col("up").alias("id")), "id", "left_anti")
    rows = materialize(leaves.select(F.col("id").alias("leaf"), "root", F.col("id").alias("at"), "depth", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("climb")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        up = materialize(up)
        climbs = F.col("climb").bitwiseAND(F.lit(step)) != 0
        moved = rows.where(climbs).join(up.select(F.col("id").alias("at"), "up"), "at").drop("at").withColumnRenamed("up", "at")
        rows = materialize(rows.where(~climbs).unionByName(moved))
        up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("_far")), "up").select("id", F.col("_far").alias("up"))
        step *= 2
    paths = rows.select("leaf", "root", (F.col("depth") - F.col("climb")).alias("turn"), F.col("at").alias("id")).join(m.drop("_parent"), "id")
    return paths.select("leaf", "root", "turn", *cols), placed.where("status <> 'ok'").select("id", "status")


def dropped(threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions to drop with the first reason that holds: ``empty``, ``broken`` or ``no_reply``.

    ``sessions``: session_id, all that are known. What is decided per session is a sum, a
    minimum or a maximum, pre-aggregated before the shuffle.
    """
    talk = F.col("speaker").isin("user", "assistant")
    other = F.col("speaker").isNull() | talk
    facts = threads.groupBy("session_id").agg(
        F.sum(talk.cast("int")).alias("n"),
        F.max(F.col("speaker").isNull() | F.col("created_at").isNull()).alias("bad"),
        F.min(F.when(other, F.struct("turn", "speaker"))).alias("first"),
        F.max(F.when(other, F.struct("turn", "speaker"))).alias("last"),
    )
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty")
        .when(F.col("bad") | (F.col("first.speaker") == "assistant"), "broken")
        .when(F.col("last.speaker") == "user", "no_reply")
    )
    known = sessions.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    return known.join(facts, "session_id", "left").select("session_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def turns(threads: DataFrame, drop: DataFrame) -> DataFrame:
    """Ordered turns of the sessions that are kept."""
    return threads.join(drop.select("session_id"), "session_id", "left_anti")


def conversations(kept: DataFrame, part_size: int = 1000) -> DataFrame:
    """One row per conversation with its turns in order; those of more than ``part_size`` turns come in
    numbered parts, so that no row grows without bound."""
    return (
        kept.groupBy("session_id", F.floor(F.col("turn") / part_size).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "content"))).alias("turns"))
        .withColumn("n_turns", F.size("turns"))
    )
