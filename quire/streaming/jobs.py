"""Streaming jobs. Checkpoints live in the folder the caller names, normally below ``spark.checkpoint.dir``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunking import ingest
from quire.sources.store import ChunkStore


def panel(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and totals per time window and event type; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        rows.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: a new one starts after ``gap`` without events. A busy user's rows are merged per task first."""
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("session_start"), "events")
    )


def start_panel(stream: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Write closed windows to Parquet and stop when the input at hand is read."""
    return (
        panel(stream, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(docs: DataFrame, store: ChunkStore, checkpoint: str, chunk: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = ingest) -> StreamingQuery:
    """Chunk arriving documents into the store, each micro-batch once.

    A micro-batch that comes again after a failure has the same number; if it was committed before, it changes nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        if not store.committed(name):
            store.ingest_once(*chunk(batch), name)

    return (
        docs.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def suspended_too_long(states: DataFrame, now: dt.datetime, minutes: int = 30) -> DataFrame:
    """Documents still suspending ``minutes`` after their mark; plain filter, so it also runs on a stream."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return states.where((F.col("status") == "suspending") & (F.col("at") < limit))
