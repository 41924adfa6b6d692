"""Streaming variants of the monthly rates: beyond batch, the same columns as the batch operators.

Each takes a streaming (or batch) frame of events and returns one; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rate(events: DataFrame, time: str, flag: Column, by: list[str], width: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count and rate of a flag per window and key; windows close when the watermark has passed them."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    g = e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "rate")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: start, end, events."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
