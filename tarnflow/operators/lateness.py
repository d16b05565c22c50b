"""Stream time and late records.

Stream time is the largest event time that a task has seen, the present record's included, zero at first; a record is
late if it is older than the stream time by more than window and grace. Over a bounded stream that is a running maximum
by arrival. One window over a whole task would sort it in one place, so it goes in two passes: the maxima of short
stretches of arrivals, running over the few stretches, and then a window within each stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrivals (by number) in a stretch.
STRETCH = 1 << 20


def with_stream_time(df: DataFrame, stretch: int = STRETCH, name: str = "stream_time") -> DataFrame:
    """df (ts, seq, part) with the stream time at each record."""
    df = df.withColumn("_stretch", F.floor(F.col("seq") / stretch).cast("bigint"))
    earlier = Window.partitionBy("part").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("part", "_stretch").agg(F.max("ts").alias("_top"))
    tops = tops.select(F.col("part").alias("_part"), F.col("_stretch").alias("_of"), F.coalesce(F.max("_top").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(tops, F.col("part").eqNullSafe(F.col("_part")) & (F.col("_stretch") == F.col("_of")))
    return joined.withColumn(name, F.greatest(F.lit(0), F.col("_before"), F.max("ts").over(within))).drop("_part", "_of", "_before", "_stretch")


def is_late(allowed_ms: int) -> Column:
    """allowed_ms: the longest window, and grace."""
    return F.col("ts") < F.col("stream_time") - F.lit(allowed_ms)
