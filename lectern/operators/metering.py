"""Usage accounting: quotas by day, limits by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_counts(usage: DataFrame, key: str = "key_id", at: str = "created_at") -> DataFrame:
    """(key, day, calls): a counter by key and day; rows without a key don't count."""
    return usage.where(F.col(key).isNotNull()).groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("calls"))


def without_repeats(usage: DataFrame, same: list[str], tie: str = "id") -> DataFrame:
    """Of rows that were logged twice the one with the smallest id."""
    rest = [c for c in usage.columns if c not in same]
    return usage.groupBy(*same).agg(F.min_by(F.struct(*rest), tie).alias("f")).select(*same, *(F.col(f"f.{c}").alias(c) for c in rest)).select(*usage.columns)


def status(calls: Column, limit: Column) -> Column:
    """403 without a limit, 429 at or beyond it, else 200."""
    return F.when(limit.isNull(), 403).when(calls >= limit, 429).otherwise(200)


def window_counts(events: DataFrame, key: str, at: str, length: str, slide: str | None = None) -> DataFrame:
    """(key, start, n): events by key in tumbling or sliding windows; the same expression serves streams."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
