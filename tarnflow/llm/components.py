"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) of all nodes in links (a, b); nodes are longs.

    A star's centre is joined to its least neighbour, never gathered: groups are only ever reduced to a least node, so
    a hub of any degree is pre-aggregated and its links stay spread. Each round is written to the shared folder, and so are
    its least neighbours, so that the join has plain exchanges on both sides, which AQE splits where a hub is.
    No links give no rows; repeated links and links of a node with itself change nothing.
    """
    now = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        centre = low.withColumnRenamed("a", "u")
        small = large.join(centre, large["a"] == centre["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = kept(small.filter("a <> b").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
