"""Event time in whole Unix milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2**63 - 1


def millis(ts: Column | str) -> Column:
    """Milliseconds of a timestamp with or without time zone (taken as the session's), rounded down."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def add_capped(ts: Column, ms: int) -> Column:
    """ts + ms, or the largest long where that overflows."""
    return F.when(ts > MOST - ms, F.lit(MOST)).otherwise(ts + F.lit(ms)) if ms > 0 else ts
