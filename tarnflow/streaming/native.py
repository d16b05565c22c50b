"""Unbounded operators by Spark's own watermarks: cheaper than the exact ones, with Spark's rule of lateness.

The watermark moves between micro-batches, is one for the whole query and drops by the window's end, so records that
the exact rule drops may be counted here. Where no record is late, both give the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import Hopping, JoinWindows, Session, Tumbling


def _timed(df: DataFrame, delay_ms: int) -> DataFrame:
    return df.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", f"{delay_ms} milliseconds")


def windowed_count(df: DataFrame, windows: Tumbling | Hopping, grace_ms: int = 0) -> DataFrame:
    hop = windows.advance_ms if isinstance(windows, Hopping) else windows.size_ms
    w = F.window("_at", f"{windows.size_ms} milliseconds", f"{hop} milliseconds")
    out = _timed(df, windows.size_ms + grace_ms).groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("value"))
    return out.select("key", F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), "value").filter("window_start >= 0")


def session_count(df: DataFrame, sessions: Session, grace_ms: int = 0) -> DataFrame:
    w = F.session_window("_at", f"{sessions.gap_ms} milliseconds")
    out = _timed(df, sessions.gap_ms + grace_ms).groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("value"))
    return out.select("key", F.unix_millis("w.start").alias("session_start"), (F.unix_millis("w.end") - sessions.gap_ms).alias("session_end"), "value")


def join_streams(left: DataFrame, right: DataFrame, windows: JoinWindows) -> DataFrame:
    """For windows that are as long before as after, without grace."""
    if windows.before_ms != windows.after_ms or windows.grace_ms:
        raise ValueError("only symmetric windows without grace; take the exact join")
    w = f"INTERVAL {windows.before_ms} MILLISECONDS"
    ls = _timed(left, windows.max_size_ms).select(F.col("key").alias("lk"), F.col("value").alias("left"), F.col("ts").alias("lts"), F.col("_at").alias("lat"))
    rs = _timed(right, windows.max_size_ms).select(F.col("key").alias("rk"), F.col("value").alias("right"), F.col("ts").alias("rts"), F.col("_at").alias("rat"))
    return ls.join(rs, F.expr(f"lk = rk AND rat BETWEEN lat - {w} AND lat + {w}")).select(F.col("lk").alias("key"), "left", "right", "lts", "rts")
