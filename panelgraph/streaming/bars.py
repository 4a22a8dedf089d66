"""Event-time bars from a stream: the same result as the batch aggregate over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(date, event_type, n, total) of tumbling windows; works on a stream (with a watermark) and on a table."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    bars = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return bars.select(F.to_date("window.start").alias("date"), "event_type", "n", "total")
