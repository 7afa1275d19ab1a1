"""Trajectory measures over streams: usage of segments in windows, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, at: str, segment: str, who: str, span: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, segment, visits, users): works on a stream and on a table alike.

    users is the exact number of different ``who`` on a table. A stream can't count distinct values beside others, so
    there each window keeps the set of its users as state, and the number is exact too.
    """
    base = events.filter(F.col(segment).isNotNull())
    if events.isStreaming:
        base = base.withWatermark(at, late)
    users = F.size(F.collect_set(who)).cast("bigint") if events.isStreaming else F.count_distinct(who)
    used = base.groupBy(F.window(at, span).alias("w"), segment).agg(F.count(F.lit(1)).alias("visits"), users.alias("users"))
    return used.select(F.col("w.start").alias("window_start"), segment, "visits", "users")


def sessions(events: DataFrame, at: str, who: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(who, begin, end, steps): stays of one person with no longer gap than ``gap``."""
    base = events.filter(F.col(who).isNotNull())
    if events.isStreaming:
        base = base.withWatermark(at, late)
    got = base.groupBy(F.session_window(at, gap).alias("s"), who).agg(F.count(F.lit(1)).alias("steps"))
    return got.select(who, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "steps")
