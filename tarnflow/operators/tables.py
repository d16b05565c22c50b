"""Tables: aggregates as the last value of each key, and as the stream of their updates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class PythonFold:
    """A left fold in order of arrival with Python functions: init() and step(key, value, acc). For what columns can't say, and
    for unbounded streams. Rows are dealt out and sorted by key, and go through in Arrow batches, so a key of any size only
    costs its task time. What step returns is never changed afterwards; it mustn't change what it is given either."""

    init: Callable[[], object]
    step: Callable[[object, object, object], object]
    kind: str

    def _run(self, df: DataFrame, keys: list[str], every: bool) -> DataFrame:
        fields = df.schema.fields if every else [df.schema[k] for k in keys]
        schema = T.StructType([T.StructField("value", T._parse_datatype_string(self.kind)) if f.name == "value" else f for f in fields])
        if not every:
            schema = schema.add("value", T._parse_datatype_string(self.kind))
        arrow, init, step = to_arrow_schema(schema), self.init, self.step
        # Found by place, as other columns may have names that differ by case alone.
        at, of_key, of_value = [df.columns.index(k) for k in keys], df.columns.index(keys[0]), df.columns.index("value")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, acc, open_ = None, None, False
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
                out: list[tuple] = []
                for row, key, value in zip(rows, batch.column(of_key).to_pylist(), batch.column(of_value).to_pylist(), strict=True):
                    if not open_ or row != now:
                        if open_ and not every:
                            out.append((*now, acc))
                        now, acc, open_ = row, init(), True
                    acc = step(key, value, acc)
                    if every:
                        out.append((acc,))
                if every:
                    made = pa.array([x[0] for x in out], arrow.field("value").type)
                    yield pa.RecordBatch.from_arrays([made if i == of_value else batch.column(i) for i in range(batch.num_columns)], schema=arrow)
                elif out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            if open_ and not every:
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, acc), arrow, strict=True)], schema=arrow)

        return df.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, schema)

    def changelog(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return self._run(df, keys, every=True)

    def snapshot(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """A row for each key; nothing but the last value leaves the fold."""
        return self._run(df, keys, every=False)


@dataclass(frozen=True)
class Declared:
    """An aggregate that Spark knows: of the value column, to a column. Partial aggregation comes for free. fold: the same for unbounded streams."""

    of: Callable[[Column], Column]
    fold: PythonFold | None = None

    def snapshot(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(self.of(F.col("value")).alias("value"))

    def changelog(self, df: DataFrame, keys: list[str]) -> DataFrame:
        running = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("value", self.of(F.col("value")).over(running))


@dataclass(frozen=True)
class ColumnFold:
    """A left fold in order of arrival with column expressions: init, and step(acc, value), both of the type given. A key's rows are
    gathered into one array, so they must fit in a row (2 GB); PythonFold has no such bound."""

    init: Column
    step: Callable[[Column, Column], Column]
    kind: str  # the accumulator's type
    fold: PythonFold | None = None

    def _gathered(self, df: DataFrame, keys: list[str], *more: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "value", *more))).alias("_rows"))

    def snapshot(self, df: DataFrame, keys: list[str]) -> DataFrame:
        last = F.aggregate("_rows", self.init.cast(self.kind), lambda acc, x: self.step(acc, x["value"]).cast(self.kind))
        return self._gathered(df, keys).select(*keys, last.alias("value"))

    def changelog(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """A key is folded once. Arrays grow by copies, so its rows are cut into blocks of about their number's root: a block's
        running results grow in one array, and the blocks' arrays in another."""
        more = [c for c in df.columns if c not in (*keys, "seq", "value")]
        n = F.size("_rows")
        width = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.slice("_rows", i * width + 1, width))
        begin = F.array(self.init.cast(self.kind))

        def block(done: Column, rows: Column) -> Column:
            last = F.element_at(F.element_at(done, -1), -1)
            return F.concat(done, F.array(F.aggregate(rows, F.array(last), lambda out, x: F.concat(out, F.array(self.step(F.element_at(out, -1), x["value"]).cast(self.kind))))))

        done = F.aggregate(blocks, F.array(begin), block)
        values = F.flatten(F.transform(F.slice(done, 2, F.size(blocks)), lambda out: F.slice(out, F.lit(2), F.size(out) - 1)))
        rows = self._gathered(df, keys, *more).select(*keys, "_rows", values.alias("_values"))
        rows = rows.select(*keys, F.explode(F.arrays_zip("_rows", "_values")).alias("_x"))
        names = {"value": F.col("_x._values"), "seq": F.col("_x._rows.seq"), **{c: F.col(f"_x._rows.{c}") for c in more}}
        return rows.select(*[names[c].alias(c) if c in names else F.col(c) for c in df.columns])


Aggregate = Declared | ColumnFold | PythonFold
COUNT = Declared(lambda value: F.count(F.lit(1)), PythonFold(lambda: 0, lambda key, value, acc: acc + 1, "bigint"))
SUM = Declared(F.sum, PythonFold(lambda: None, lambda key, value, acc: acc if value is None else value + (acc or 0), "bigint"))


def python_fold(how: Aggregate) -> PythonFold:
    """What an unbounded stream folds with."""
    fold = how if isinstance(how, PythonFold) else how.fold
    if fold is None:
        raise ValueError("an unbounded stream needs a PythonFold, or an aggregate that has one")
    return fold


@dataclass(frozen=True)
class Updates:
    """The updates of an unbounded table."""

    rows: DataFrame

    def changelog(self) -> DataFrame:
        return self.rows

    def snapshot(self) -> DataFrame:
        raise ValueError("an unbounded table has no snapshot but its sink's; take changelog()")

    def to(self, path: str, encode: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> None:
        raise ValueError("start changelog() as a query of the runner's")


@dataclass(frozen=True)
class Table:
    """An aggregate over keyed rows. Windows are part of the key: keys names key, and window_start and window_end."""

    rows: DataFrame
    aggregate: Aggregate
    keys: tuple[str, ...] = ("key",)

    def snapshot(self) -> DataFrame:
        """The last value of each key."""
        if self.rows.isStreaming:
            return Updates(self.rows).snapshot()
        return self.aggregate.snapshot(self.rows, list(self.keys))

    def changelog(self) -> DataFrame:
        """A row for each record that the table took in: keys, value, ts, seq."""
        if self.rows.isStreaming:
            from ..streaming import exact

            fold = python_fold(self.aggregate)
            return exact.changelog(self.rows, fold.init, fold.step, fold.kind)
        return self.aggregate.changelog(self.rows, list(self.keys)).select(*self.keys, "value", "ts", "seq")

    def to(self, path: str, encode: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> None:
        """Every update of the table, as Parquet."""
        out = self.changelog()
        (encode(out) if encode else out).write.options(**options).parquet(path)


@dataclass(frozen=True)
class GlobalTable:
    """The last value of each key of a whole topic, for lookups by any key. A null value deletes its key.

    It is broadcast only if Spark finds it small enough (its statistics, or at run time); a large one is joined by a shuffle. If
    rows are unbounded, a stream sees the table as it is when a record arrives, by seq.
    """

    rows: DataFrame

    def latest(self) -> DataFrame:
        last = Window.partitionBy("key").orderBy(F.desc("seq"))
        return self.rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and value is not null").select("key", "value")
