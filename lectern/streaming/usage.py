"""Usage accounting on streams; the batch operators are the reference for closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_quota(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """(key, start, n): calls by key and day of an event stream; events later than the watermark are left out."""
    counted = events.where(F.col(key).isNotNull()).withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n")


def rate_windows(events: DataFrame, key: str, at: str, length: str = "1 minute", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n): tumbling or sliding counts for rate limits."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    counted = events.where(F.col(key).isNotNull()).withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n): runs of events no further apart than ``gap``."""
    counted = events.where(F.col(key).isNotNull()).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
