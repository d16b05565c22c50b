"""The three joins, over bounded streams.

Whoever arrives looks at what is there, so the order of arrival is part of each join's condition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import MOST, add_capped
from .lateness import is_late, with_stream_time
from .tables import GlobalTable, Table
from .windows import JoinWindows

Joiner = Callable[[Column, Column], Column]


def join_global(df: DataFrame, table: GlobalTable, key: Callable[[Column, Column], Column], joiner: Joiner) -> DataFrame:
    """Looks up a derived key; records that miss go. Key and time stay the stream's. Spark picks the broadcast, by size."""
    if key is None:
        raise ValueError("a key function is needed")
    right = table.latest().select(F.col("key").alias("_gk"), F.col("value").alias("_gv"))
    joined = df.withColumn("_k", key(F.col("key"), F.col("value"))).join(right, F.col("_k") == F.col("_gk"))
    return joined.withColumn("value", joiner(F.col("value"), F.col("_gv"))).select(*df.columns)


def join_table(df: DataFrame, table: Table, joiner: Joiner, table_first: bool = True) -> DataFrame:
    """The table's value when the record arrives; nothing if there was none yet. One sort by key and arrival of both, no pairs.

    table_first: at the same seq (a source that feeds both) the table is updated first."""
    if table.keys != ("key",):
        raise ValueError("only tables without windows can be joined")
    log = table.changelog()
    ours, theirs = (1, 0) if table_first else (0, 1)
    left = df.select(*df.columns, F.lit(None).cast(log.schema["value"].dataType).alias("_t"), F.lit(ours).alias("_side"))
    right = log.select(*[F.col(c) if c in ("key", "seq") else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.col("value").alias("_t"), F.lit(theirs).alias("_side"))
    so_far = Window.partitionBy("key").orderBy("seq", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_t", F.last("_t", ignorenulls=True).over(so_far))
    return both.filter((F.col("_side") == ours) & F.col("_t").isNotNull()).withColumn("value", joiner(F.col("value"), F.col("_t"))).select(*df.columns)


def tagged(left: DataFrame, right: DataFrame, windows: JoinWindows, stretch: int) -> DataFrame:
    """Both sides' records with one stream time, and whether each is late. Values are left out: they join back where needed."""
    sides = [d.select("key", "ts", "seq", "part", F.lit(s).alias("_side"), F.struct("value").alias("_l" if s == 0 else "_r")) for s, d in ((0, left), (1, right))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return with_stream_time(both, stretch).withColumn("late", is_late(windows.max_size_ms + windows.grace_ms))


def join_streams(left: DataFrame, right: DataFrame, joiner: Joiner, windows: JoinWindows, stretch: int) -> DataFrame:
    """Inner join of records within the windows. The later arrival triggers: it looks from before + grace ahead of its own
    time to after behind it, and its time is the result's. A record stops to be found once its side has another one of
    the same key and time. Joined by key and stretch of time, so that a hot key's records don't all meet each other."""
    both = tagged(left, right, windows, stretch).filter(~F.col("late"))
    again = Window.partitionBy("_side", "key", "ts").orderBy("seq")
    both = both.withColumn("until", F.coalesce(F.lead("seq").over(again), F.lit(MOST)))
    reach = max(windows.before_ms + windows.grace_ms, windows.after_ms, 1)
    slot = F.col("ts") - F.pmod(F.col("ts"), F.lit(reach))
    ls = both.filter("_side = 0").select(F.col("key").alias("lk"), F.col("ts").alias("lts"), F.col("seq").alias("lseq"), F.col("until").alias("luntil"), F.col("part").alias("lpart"), F.col("_l.value").alias("lv"), slot.alias("lslot"))
    near = F.explode(F.array(slot - reach, slot, F.try_add(slot, F.lit(reach))))
    rs = both.filter("_side = 1").select(F.col("key").alias("rk"), F.col("ts").alias("rts"), F.col("seq").alias("rseq"), F.col("until").alias("runtil"), F.col("part").alias("rpart"), F.col("_r.value").alias("rv"), near.alias("rslot"))

    def seen(trigger: str, other: str) -> Column:
        ts, low = F.col(f"{trigger}ts"), windows.before_ms + windows.grace_ms
        lowest = F.greatest(F.lit(0), ts - low)
        return (F.col(f"{trigger}seq") > F.col(f"{other}seq")) & (F.col(f"{trigger}seq") < F.col(f"{other}until")) & F.col(f"{other}ts").between(lowest, add_capped(ts, windows.after_ms))

    left_last = F.col("lseq") > F.col("rseq")
    pairs = ls.join(rs, (F.col("lk") == F.col("rk")) & (F.col("lslot") == F.col("rslot")) & (seen("l", "r") | seen("r", "l")))
    return pairs.select(
        F.col("lk").alias("key"),
        joiner(F.col("lv"), F.col("rv")).alias("value"),
        F.when(left_last, F.col("lts")).otherwise(F.col("rts")).alias("ts"),
        F.greatest("lseq", "rseq").alias("seq"),
        F.when(left_last, F.col("lpart")).otherwise(F.col("rpart")).alias("part"),
    )


