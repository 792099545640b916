"""Keeping an index current: debounced file events, and batches of changed files found by comparing snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.upserts import changed

WRITES = ("write", "create")


def debounced(events: DataFrame, key: str, time: str, quiet: str, watermark: str | None = None) -> DataFrame:
    """(key, first_event, last_event, n_events): runs of a key's events with gaps of at most ``quiet``; each is one update.

    Works on batches and, with a watermark, on streams in append mode: a run is given once it has been quiet. An event
    exactly at the gap belongs to the run. Events with a null key or time take no part.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if watermark:
        rows = rows.withWatermark(time, watermark)
    runs = rows.groupBy(key, F.session_window(time, quiet).alias("run")).agg(F.min(time).alias("first_event"), F.max(time).alias("last_event"), F.count("*").alias("n_events"))
    return runs.select(key, "first_event", "last_event", "n_events")


def snapshot_changes(before: DataFrame, now: DataFrame, key: str = "path", *marks: str) -> DataFrame:
    """(key, state): new, changed and removed files between two snapshots; a stream of files doesn't see edits in place."""
    marks = marks or ("hash", "last_modified")
    there = changed(now, before, key, *marks).where("state <> 'unchanged'").select(key, "state")
    gone = before.join(now, key, "left_anti").select(key, F.lit("removed").alias("state"))
    return there.unionByName(gone)


def run_updates(stream: DataFrame, update: Callable[[DataFrame, int], None], name: str, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Starts one query of that name, stopping an earlier one, that hands each batch of updates to ``update``."""
    for query in stream.sparkSession.streams.active:
        if query.name == name:
            query.stop()
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(update).start()
