"""The chainable API over keyed streams.

A stream is a DataFrame of key, value, ts (event time, Unix milliseconds), seq (order of arrival, unique) and part (the
task). Functions of records are functions of columns, so Catalyst sees them and pushes them down; key changes need no
repartition topic, as Spark's planner puts an exchange before whatever needs one. The same calls build unbounded
topologies: over a streaming DataFrame, tables are their updates, and what needs state goes to streaming.exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.serde import Serde
from ..streaming import exact
from . import joins
from .lateness import STRETCH, is_late, with_stream_time
from .tables import COUNT, Aggregate, GlobalTable, Table, Updates, python_fold
from .windows import JoinWindows, Session, WindowDefinition

ENVELOPE = ("key", "value", "ts", "seq", "part")
RecordFn = Callable[[Column, Column], Column]


@dataclass
class Builder:
    """Names sources and sinks, and checks that there is one of each."""

    spark: SparkSession
    sources: dict[str, DataFrame] = field(default_factory=dict)
    sinks: dict[str, DataFrame] = field(default_factory=dict)
    globals: dict[str, GlobalTable] = field(default_factory=dict)

    def _name(self, name: str) -> None:
        if name in self.sources or name in self.sinks or name in self.globals:
            raise ValueError(f"the name {name} is taken")

    def stream(self, name: str, rows: DataFrame, key_serde: Serde | None = None, value_serde: Serde | None = None, stretch: int = STRETCH) -> Stream:
        """rows: key, value, ts, seq, and part if there is more than one task."""
        self._name(name)
        df = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
        if missing := set(ENVELOPE) - set(df.columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        df = df.select(*ENVELOPE)
        for column, serde in (("key", key_serde), ("value", value_serde)):
            if serde:
                df = df.withColumn(column, serde.decode(F.col(column)))
        self.sources[name] = df
        return Stream(df, self, stretch)

    def global_table(self, name: str, rows: DataFrame) -> GlobalTable:
        """rows: key, value, seq."""
        self._name(name)
        self.globals[name] = GlobalTable(rows.select("key", "value", "seq"))
        return self.globals[name]

    def build(self) -> dict[str, DataFrame]:
        """The sinks by name."""
        if not self.sources:
            raise ValueError("no source")
        if not self.sinks:
            raise ValueError("no sink")
        return dict(self.sinks)

    def run(self, folder: str) -> None:
        """Writes each sink to its own folder, as Parquet."""
        for name, df in self.build().items():
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    builder: Builder | None = None
    stretch: int = STRETCH

    def _with(self, df: DataFrame) -> Stream:
        return replace(self, df=df)

    def filter(self, keep: RecordFn) -> Stream:
        return self._with(self.df.filter(keep(F.col("key"), F.col("value"))))

    def map_values(self, value: RecordFn) -> Stream:
        return self._with(self.df.withColumn("value", value(F.col("key"), F.col("value"))))

    def map(self, key: RecordFn, value: RecordFn) -> Stream:
        """Both from the old key and value."""
        return self._with(self.df.withColumns({"key": key(F.col("key"), F.col("value")), "value": value(F.col("key"), F.col("value"))}))

    def select_key(self, key: RecordFn) -> Stream:
        return self._with(self.df.withColumn("key", key(F.col("key"), F.col("value"))))

    def repartition(self, partitions: int = 0) -> Stream:
        """Deals the stream out by key. Needed for no operator here; 0 leaves the number to Spark."""
        if partitions < 0:
            raise ValueError("partitions must not be negative")
        return self._with(self.df.repartition(partitions, "key") if partitions else self.df.repartition("key"))

    def merge(self, other: Stream) -> Stream:
        return self._with(self.df.unionByName(other.df))

    def group_by_key(self) -> Grouped:
        return Grouped(self)

    def join_global(self, table: GlobalTable, key: RecordFn, joiner: Callable[[Column, Column], Column]) -> Stream:
        """Both unbounded: lookups see the table's changes up to the record. An unbounded stream and a bounded table: a static lookup."""
        if self.df.isStreaming and table.rows.isStreaming:
            if key is None:
                raise ValueError("a key function is needed")
            return self._joined(exact.join_global(self.df, table.rows, key), joiner(F.col("value"), F.col("table_value")))
        return self._with(joins.join_global(self.df, table, key, joiner))

    def join_table(self, table: Table, joiner: Callable[[Column, Column], Column], table_first: bool = True) -> Stream:
        if self.df.isStreaming:
            if table.keys != ("key",):
                raise ValueError("only tables without windows can be joined")
            if not table_first:
                raise ValueError("an unbounded table is updated first")
            fold = python_fold(table.aggregate)
            return self._joined(exact.join_table(self.df, table.rows, fold.init, fold.step, fold.kind), joiner(F.col("value"), F.col("table_value")))
        return self._with(joins.join_table(self.df, table, joiner, table_first))

    def join(self, other: Stream, joiner: Callable[[Column, Column], Column], windows: JoinWindows) -> Stream:
        if self.df.isStreaming:
            return self._joined(exact.join_streams(self.df, other.df, windows), joiner(F.col("left"), F.col("right")))
        return self._with(joins.join_streams(self.df, other.df, joiner, windows, self.stretch))

    def _joined(self, df: DataFrame, value: Column) -> Stream:
        return self._with(df.select("key", value.alias("value"), "ts", "seq", "part"))

    def late_in_join(self, other: Stream, windows: JoinWindows) -> DataFrame:
        """late_count: the records that the join drops; unbounded: part, late_count, seq, a row for each batch of a task."""
        if self.df.isStreaming:
            columns = ["ts", "seq", "part"]
            return exact.late_count(self.df.select(*columns).unionByName(other.df.select(*columns)), windows.max_size_ms + windows.grace_ms)
        return joins.tagged(self.df, other.df, windows, self.stretch).agg(F.sum(F.col("late").cast("bigint")).alias("late_count"))

    def to(self, name: str, key_serde: Serde | None = None, value_serde: Serde | None = None) -> Stream:
        df = self.df
        for column, serde in (("key", key_serde), ("value", value_serde)):
            if serde:
                df = df.withColumn(column, serde.encode(F.col(column)))
        if self.builder is None:
            raise ValueError("the stream has no builder")
        self.builder._name(name)
        self.builder.sinks[name] = df
        return self


@dataclass(frozen=True)
class Grouped:
    stream: Stream

    def count(self) -> Table:
        return self.aggregate(COUNT)

    def aggregate(self, how: Aggregate) -> Table:
        return Table(self.stream.df, how)

    def windowed_by(self, windows: WindowDefinition) -> TimeWindowed:
        return TimeWindowed(self.stream, windows)

    def session_windowed_by(self, sessions: Session) -> SessionWindowed:
        return SessionWindowed(self.stream, sessions)


@dataclass(frozen=True)
class _Timed:
    stream: Stream
    windows: WindowDefinition | Session
    grace_ms: int = 0
    extractor: Callable[[Column, Column], Column] | None = None

    def with_grace(self, ms: int):
        if ms < 0:
            raise ValueError("grace must not be negative")
        return replace(self, grace_ms=ms)

    def with_timestamp_extractor(self, ts: RecordFn):
        """Another event time, for this operator alone."""
        return replace(self, extractor=ts)

    def _reach(self) -> int:
        return self.windows.gap_ms if isinstance(self.windows, Session) else self.windows.max_size_ms

    def _timed(self) -> DataFrame:
        df = self.stream.df
        return df.withColumn("ts", self.extractor(F.col("key"), F.col("value")).cast("bigint")) if self.extractor else df

    def _tagged(self) -> DataFrame:
        return with_stream_time(self._timed(), self.stream.stretch).withColumn("late", is_late(self._reach() + self.grace_ms))

    def accepted(self) -> DataFrame:
        return self._tagged().filter(~F.col("late")).drop("late", "stream_time")

    def late_count(self) -> DataFrame:
        """late_count: how many records are dropped; unbounded: part, late_count, seq, a row for each batch of a task."""
        if self.stream.df.isStreaming:
            return exact.late_count(self._timed(), self._reach() + self.grace_ms)
        return self._tagged().agg(F.coalesce(F.sum(F.col("late").cast("bigint")), F.lit(0)).cast("bigint").alias("late_count"))


@dataclass(frozen=True)
class TimeWindowed(_Timed):
    def count(self) -> Table | Updates:
        return self.aggregate(COUNT)

    def aggregate(self, how: Aggregate) -> Table | Updates:
        """A record goes to all windows that its time is in."""
        if self.stream.df.isStreaming:
            fold = python_fold(how)
            return Updates(exact.windowed(self._timed(), self.windows, self.grace_ms, fold.init, fold.step, fold.kind))
        rows = self.accepted().withColumn("_w", F.explode(self.windows.assign(F.col("ts"))))
        rows = rows.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
        return Table(rows, how, ("key", "window_start", "window_end"))


@dataclass(frozen=True)
class SessionWindowed(_Timed):
    """Sessions are (key, session_start, session_end, value); the end is the last event's time."""

    def count(self) -> DataFrame:
        if self.stream.df.isStreaming:
            return self.fold(lambda: 0, lambda key, value, acc: acc + 1, lambda a, b: a + b, "bigint")
        return self.aggregate(F.count(F.lit(1)))

    def aggregate(self, value: Column) -> DataFrame:
        """value: an aggregate of the column value that doesn't depend on the order in which sessions met."""
        if self.stream.df.isStreaming:
            raise ValueError("an unbounded stream needs fold")
        window = F.session_window(F.timestamp_millis("ts"), f"{self.windows.gap_ms} milliseconds")
        out = self.accepted().groupBy("key", window.alias("_s")).agg(value.alias("value"))
        return out.select("key", F.unix_millis("_s.start").alias("session_start"), (F.unix_millis("_s.end") - self.windows.gap_ms).alias("session_end"), "value")

    def fold(self, init: Callable[[], object], step: Callable, merge: Callable, kind: str) -> DataFrame:
        """step(key, value, acc) and merge(a, b) in Python, in order of arrival: a record takes the sessions within the gap, which are
        merged from the earliest on, and is folded in last; only a new session begins with init(). Rows are dealt out and sorted
        by key and go through in Arrow batches; sessions that no accepted record can reach any more are given out at once.
        Unbounded: the updates, with the starts of the sessions that each one replaces."""
        gap, grace = self.windows.gap_ms, self.grace_ms
        if self.stream.df.isStreaming:
            return exact.sessions(self._timed(), gap, grace, init, step, merge, kind)
        rows = self._tagged().filter(~F.col("late")).select("key", "value", "ts", "seq", "stream_time")
        schema = T.StructType([rows.schema["key"], *(T.StructField(n, T.LongType()) for n in ("session_start", "session_end")), T.StructField("value", T._parse_datatype_string(kind))])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, first = None, True
            open_: list[list] = []  # start, end, acc; apart by more than the gap
            for batch in batches:
                out: list[tuple] = []
                for key, value, ts, top in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    if first or key != now:
                        out += [(now, *s) for s in open_]
                        now, first, open_ = key, False, []
                    near = sorted((s for s in open_ if s[1] + gap >= ts >= s[0] - gap), key=lambda s: s[0])
                    acc = near[0][2] if near else init()
                    for s in near[1:]:
                        acc = merge(acc, s[2])
                    made = [min([ts, *(s[0] for s in near)]), max([ts, *(s[1] for s in near)]), step(key, value, acc)]
                    apart = [s for s in open_ if not s[1] + gap >= ts >= s[0] - gap]
                    out += [(key, *s) for s in apart if s[1] < top - 2 * gap - grace]
                    open_ = [s for s in apart if s[1] >= top - 2 * gap - grace] + [made]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            if open_:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(now, *s) for s in open_], strict=True), arrow, strict=True)], schema=arrow)

        return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, schema)
