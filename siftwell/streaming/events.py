"""Event streams: debounced file changes, event-time windows, running counts of references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Milliseconds of quiet after which a changed file is looked at (fixed value).
DEBOUNCE_MS = 300


def debounce(events: DataFrame, gap_ms: int = DEBOUNCE_MS, late: str | None = None) -> DataFrame:
    """path, first_at, last_at, change, n_events: bursts of events (path, change, ts) of one file that are at most ``gap_ms``
    apart; the last change of a burst counts. Batch or stream; a stream needs ``late``, its watermark."""
    e = events if late is None else events.withWatermark("ts", late)
    return (
        e.where(F.col("path").isNotNull() & F.col("ts").isNotNull())
        .groupBy("path", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
        .agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("change", F.struct("ts", "change")).alias("change"), F.count("*").alias("n_events"))
        .drop("w")
    )


def windowed(events: DataFrame, size: str, key: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time counts per key: start, key, n_events."""
    e = events if late is None else events.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("start"), key, "n_events")


def reindex(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, gap_ms: int = DEBOUNCE_MS, late: str = "1 second") -> StreamingQuery:
    """Start a query that hands each trigger's debounced changes to ``handle``, one trigger at a time.

    ``handle`` must be idempotent by batch id: a trigger is repeated after a failure.
    """
    return debounce(events, gap_ms, late).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def running_references(deltas: DataFrame) -> DataFrame:
    """Running state of a stream of reference and existence deltas, see :mod:`siftwell.operators.references`; write it in
    ``update`` or ``complete`` mode."""
    from siftwell.operators.references import accumulate

    return accumulate(deltas)


def read_files(spark, path: str, per_trigger: int = 100) -> DataFrame:
    """Stream of whole files of a folder: path, content, modified; ``per_trigger`` files at once. Progress is in the checkpoint
    of the query, so that it goes on where it stopped."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return s.option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).load(path).select("path", F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("modified"))
