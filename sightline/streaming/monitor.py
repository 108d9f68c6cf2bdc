"""Monitoring windows, the same for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts and means of each event type and window. On a stream, events later than the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
