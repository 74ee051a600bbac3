"""Structured Streaming counterparts of the batch session and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): gap sessions of a stream, closed once the watermark passes them. A gap of exactly the length merges, as in batch.

    ended is the last event's time plus the gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def streaming_rates(events: DataFrame, ts: str, label: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(started, n, positive_rate) over tumbling or sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate")).select(F.col("w.start").alias("started"), "n", "positive_rate")
