"""Hourly bars of an event stream; the same aggregation runs over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """symbol, hour, open, high, low, close, n of events with a value. ``late``: watermark of a stream."""
    e = events.where(F.col("value").isNotNull())
    if late:
        e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    return g.select("symbol", F.col("w.start").alias("hour"), "open", "high", "low", "close", "n")


def start(events: DataFrame, name: str, late: str = "10 minutes"):
    """A query that appends closed hours to an in-memory table."""
    return hourly(events, late).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
