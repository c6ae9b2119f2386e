"""Streams, an extension: sessions and windowed counts over event time with late data bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.state import IDLE_MINUTES


def stream_sessions(events: DataFrame, user: str, at: str, *, minutes: int = IDLE_MINUTES, late: str = "1 hour") -> DataFrame:
    """Sessions of each user, emitted once the watermark has passed their end. State is dropped with them, so it is bounded by ``late``."""
    timed = events.withWatermark(at, late)
    grouped = timed.groupBy(F.session_window(at, f"{minutes} minutes").alias("session"), F.col(user))
    return grouped.agg(F.count("*").alias("events")).select(user, F.col("session.start").alias("begins"), F.col("session.end").alias("ends"), "events")


def stream_counts(events: DataFrame, kind: str, at: str, *, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each kind in tumbling, or with ``slide`` in sliding, windows."""
    timed = events.withWatermark(at, late)
    return timed.groupBy(F.window(at, window, slide).alias("w"), F.col(kind)).agg(F.count("*").alias("events")).select(kind, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "events")


def first_of_key(events: DataFrame, key: list[str], at: str, *, late: str = "1 day") -> DataFrame:
    """Each key's first event, redelivered ones dropped while the watermark remembers them."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a memory table; for tests and batch-like backfills of small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)
