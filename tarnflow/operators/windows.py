"""Window definitions over event time in milliseconds. Windows are [start, end); sessions end with their last event."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = "array<struct<start:bigint,end:bigint>>"


class WindowDefinition(Protocol):
    """A custom assigner: the windows of a time, and the length of the longest."""

    @property
    def max_size_ms(self) -> int: ...

    def assign(self, ts: Column) -> Column:
        """array<struct<start bigint, end bigint>>"""
        ...


@dataclass(frozen=True)
class Tumbling:
    size_ms: int

    def __post_init__(self):
        if self.size_ms <= 0:
            raise ValueError("the size must be positive")

    @property
    def max_size_ms(self) -> int:
        return self.size_ms

    def start(self, ts: Column) -> Column:
        """Division that cuts off towards zero."""
        return (ts - ts % self.size_ms).cast("bigint")

    def assign(self, ts: Column) -> Column:
        return F.array(F.struct(self.start(ts).alias("start"), (self.start(ts) + self.size_ms).alias("end")))


@dataclass(frozen=True)
class Hopping:
    """All aligned starts in (ts - size, ts] that aren't negative."""

    size_ms: int
    advance_ms: int

    def __post_init__(self):
        if self.size_ms <= 0 or not 0 < self.advance_ms <= self.size_ms:
            raise ValueError("size and advance must be positive, and the advance at most the size")

    @property
    def max_size_ms(self) -> int:
        return self.size_ms

    def assign(self, ts: Column) -> Column:
        a, size = self.advance_ms, self.size_ms
        last = ts - F.pmod(ts, F.lit(a))
        earliest = ts - size + a
        first = F.greatest(F.lit(0).cast("bigint"), earliest - F.pmod(earliest, F.lit(a)))
        starts = F.when(last >= first, F.sequence(first, last, F.lit(a).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))


@dataclass(frozen=True)
class Session:
    gap_ms: int

    def __post_init__(self):
        if self.gap_ms <= 0:
            raise ValueError("the gap must be positive")


@dataclass(frozen=True)
class JoinWindows:
    """How far before and after its own time a record looks on the other side when it arrives."""

    before_ms: int
    after_ms: int
    grace_ms: int = 0

    def __post_init__(self):
        if self.before_ms < 0 or self.after_ms < 0 or self.grace_ms < 0:
            raise ValueError("before, after and grace must not be negative")

    @property
    def max_size_ms(self) -> int:
        return self.before_ms + self.after_ms
