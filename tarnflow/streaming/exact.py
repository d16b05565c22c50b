"""Unbounded operators with the bounded ones' semantics: per record, in order of arrival, against exact stream time.

Each is a stateful processor over Spark's state store (RocksDB) with typed state. Rows of a micro-batch are sorted by seq
before they are handled. A first processor, keyed by task, gives each record its task's stream time and whether it is
late: a task's records pass through one worker there, so a busy stream wants several tasks. Windows, sessions and joins
are keyed by buckets of keys rather than by key: a bucket learns the stream time from any of its records, and drops what
that has passed for keys that never come again as well. What is due is found in an index of time slots, not by a scan.
A key belongs to one task, as it does after a repartition; a bucket with several tasks waits for the slowest of them.
State lives in the query's checkpoint and is there again after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import JoinWindows, WindowDefinition

_LONG = T.LongType()
#: Of keys, for each windowed operator: how many workers can share it.
BUCKETS = 64


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _applied(df: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def _bucketed(df: DataFrame, processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return _applied(df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")), "bucket", processor, schema)


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def stored(kind: T.DataType) -> T.DataType:
    """The type as the state store takes it: maps are arrays of entries there."""
    if isinstance(kind, T.MapType):
        return T.ArrayType(_struct(key=stored(kind.keyType), value=stored(kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(stored(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, stored(f.dataType), f.nullable) for f in kind])
    return kind


def put(kind: T.DataType, x):
    """A value for the state store: rows as tuples, maps as lists of entries."""
    if x is None:
        return None
    if isinstance(kind, T.MapType):
        return [(put(kind.keyType, k), put(kind.valueType, v)) for k, v in x.items()]
    if isinstance(kind, T.ArrayType):
        return [put(kind.elementType, v) for v in x]
    if isinstance(kind, T.StructType):
        return tuple(put(f.dataType, x[f.name] if isinstance(x, dict) else x[i]) for i, f in enumerate(kind))
    return x


def got(kind: T.DataType, x):
    """A value from the state store."""
    if x is None:
        return None
    if isinstance(kind, T.MapType):
        return {got(kind.keyType, k): got(kind.valueType, v) for k, v in x}
    if isinstance(kind, T.ArrayType):
        return [got(kind.elementType, v) for v in x]
    if isinstance(kind, T.StructType):
        return Row(*kind.names)(*(got(f.dataType, x[i]) for i, f in enumerate(kind)))
    return x


def _by_arrival(rows) -> list[Row]:
    return sorted(rows, key=lambda r: r["seq"])


# Stream time


class _StreamTime(StatefulProcessor):
    def __init__(self, allowed_ms: int):
        self.allowed = allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("stream_time", _struct(v=_LONG))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:
        top = self.top.get()[0] if self.top.exists() else 0
        for r in _by_arrival(rows):
            top = max(top, r["ts"])
            yield Row(**r.asDict(), late=r["ts"] < top - self.allowed, stream_time=top)
        self.top.update((top,))


def tagged(df: DataFrame, allowed_ms: int) -> DataFrame:
    """df (key, value, ts, seq, part) with the stream time at each record, and whether it is late."""
    return _applied(df, "part", _StreamTime(allowed_ms), T.StructType([*df.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("stream_time", _LONG)]))


def _accepted(df: DataFrame, allowed_ms: int) -> DataFrame:
    return tagged(df, allowed_ms).filter(~F.col("late")).drop("late")


class _LateCount(StatefulProcessor):
    def __init__(self, allowed_ms: int):
        self.allowed = allowed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("late", _struct(top=_LONG, late=_LONG))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:
        top, late = self.state.get() if self.state.exists() else (0, 0)
        seq = None
        for r in _by_arrival(rows):
            top, seq = max(top, r["ts"]), r["seq"]
            late += r["ts"] < top - self.allowed
        self.state.update((top, late))
        yield Row(part=key[0], late_count=late, seq=seq)


def late_count(df: DataFrame, allowed_ms: int) -> DataFrame:
    """part, late_count, seq: a task's late records so far, a row for each micro-batch that it takes part in."""
    return _applied(df.select("ts", "seq", "part"), "part", _LateCount(allowed_ms), T.StructType([*_fields(df, "part"), T.StructField("late_count", _LONG), *_fields(df, "seq")]))


# Tables


class _Fold(StatefulProcessor):
    """Folds a key's records in order of arrival; a row for each."""

    def __init__(self, init, step, kind: T.DataType):
        self.start, self.step, self.kind = init, step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("table", _struct(v=stored(self.kind)))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:
        acc = got(self.kind, self.state.get()[0]) if self.state.exists() else self.start()
        for r in _by_arrival(rows):
            acc = self.step(r["key"], r["value"], acc)
            yield Row(key=r["key"], value=acc, ts=r["ts"], seq=r["seq"])
        self.state.update((put(self.kind, acc),))


def changelog(df: DataFrame, init: Callable[[], object], step: Callable, kind: str) -> DataFrame:
    """A table's updates: key, value, ts, seq, one for each record."""
    made = T._parse_datatype_string(kind)
    return _applied(df, "key", _Fold(init, step, made), T.StructType([*_fields(df, "key"), T.StructField("value", made), *_fields(df, "ts", "seq")]))


class _TableJoin(StatefulProcessor):
    """Records of side 0 change what the key has, those of side 1 look it up. step: None takes over the record's own table value, and a null deletes it."""

    def __init__(self, init, step, kind: T.DataType):
        self.start, self.step, self.kind = init, step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("table", _struct(v=stored(self.kind)))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:
        before = seen = self.state.exists()
        acc = got(self.kind, self.state.get()[0]) if seen else self.start()
        for r in sorted(rows, key=lambda r: (r["seq"], r["side"])):
            if r["side"] == 0 and self.step:
                acc, seen = self.step(r["key"], r["value"], acc), True
            elif r["side"] == 0:
                acc, seen = r["table_value"], r["table_value"] is not None
            elif seen:
                yield Row(key=r["key"], value=r["value"], table_value=acc, ts=r["ts"], seq=r["seq"], part=r["part"])
        if seen:
            self.state.update((put(self.kind, acc),))
        elif before:
            self.state.clear()


def join_table(df: DataFrame, table_rows: DataFrame, init: Callable, step: Callable, kind: str) -> DataFrame:
    """Records with the table's value at their arrival; table_rows feed the table. Both have values of one type."""
    both = table_rows.withColumn("side", F.lit(0)).unionByName(df.withColumn("side", F.lit(1)))
    made = T._parse_datatype_string(kind)
    return _applied(both, "key", _TableJoin(init, step, made), T.StructType([*_fields(df, "key", "value"), T.StructField("table_value", made), *_fields(df, "ts", "seq", "part")]))


def join_global(df: DataFrame, table_rows: DataFrame, key: Callable[[Column, Column], Column]) -> DataFrame:
    """Records with the last value, at their arrival, of a derived key in a table that changes as well (key, value, seq). A null value deletes a key; misses go."""
    ours = df.withColumns({"lookup": key(F.col("key"), F.col("value")), "side": F.lit(1)}).filter(F.col("lookup").isNotNull())
    theirs = table_rows.select(F.col("key").alias("lookup"), F.col("value").alias("table_value"), "seq", F.lit(0).alias("side"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    kind = table_rows.schema["value"].dataType
    return _applied(both, "lookup", _TableJoin(lambda: None, None, kind), T.StructType([*_fields(df, "key", "value"), T.StructField("table_value", kind), *_fields(df, "ts", "seq", "part")]))


# What goes with the stream time


class _Swept(StatefulProcessor):
    """A bucket of keys. Subclasses say what a record does (take), what to write after a batch (flush), and what to drop when all
    that ends in a slot of time has been passed (drop). Keys are noted by the slot of their last time."""

    def __init__(self, key: T.DataType, width_ms: int, keep_ms: int):
        self.key, self.width, self.keep = key, width_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tops = handle.getMapState("tops", _struct(part=T.IntegerType()), _struct(v=_LONG))
        self.due = handle.getMapState("due", _struct(slot=_LONG), _struct(names=T.ArrayType(_struct(key=self.key, start=_LONG, end=_LONG))))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:
        self.noted: dict[int, dict[tuple, None]] = {}
        self.begin()
        tops: dict[int, int] = {}
        for r in _by_arrival(rows):
            tops[r["part"]] = max(tops.get(r["part"], 0), r["stream_time"])
            yield from self.take(r)
        self.flush()
        for slot, names in self.noted.items():
            old = {tuple(x): None for x in self.due.getValue((slot,))[0]} if self.due.containsKey((slot,)) else {}
            if len(old | names) > len(old):
                self.due.updateValue((slot,), ([(put(self.key, k), a, b) for k, a, b in old | names],))
        for part, top in tops.items():
            self.tops.updateValue((part,), (top,))
        passed = min(v[0] for v in self.tops.values()) - self.keep
        for slot in [k[0] for k in self.due.keys()]:
            if (slot + 1) * self.width <= passed:
                for name in self.due.getValue((slot,))[0]:
                    self.drop(*name, passed)
                self.due.removeKey((slot,))

    def note(self, key, start: int, end: int) -> None:
        self.noted.setdefault(end // self.width, {})[key, start, end] = None

    def _at(self, at: tuple) -> tuple:
        """The key of a state's entry: the record's key, and what comes with it."""
        return (put(self.key, at[0]), *at[1:])

    def begin(self) -> None:
        raise NotImplementedError

    def take(self, r: Row) -> Iterator[Row]:
        raise NotImplementedError

    def flush(self) -> None:
        raise NotImplementedError

    def drop(self, key, start: int, end: int, passed: int) -> None:
        raise NotImplementedError


class _Windows(_Swept):
    """Accumulators by key and start. A window goes once no record that could still be accepted lies before its end."""

    def __init__(self, key: T.DataType, init, step, kind: T.DataType, size_ms: int, grace_ms: int):
        super().__init__(key, size_ms, size_ms + grace_ms)
        self.start, self.step, self.kind = init, step, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getMapState("windows", _struct(key=self.key, start=_LONG, end=_LONG), _struct(v=stored(self.kind)))

    def begin(self) -> None:
        self.held: dict[tuple, object] = {}

    def take(self, r: Row) -> Iterator[Row]:
        for w in r["windows"]:
            at = (r["key"], w["start"], w["end"])
            if at not in self.held:
                self.held[at] = got(self.kind, self.state.getValue(self._at(at))[0]) if self.state.containsKey(self._at(at)) else self.start()
                self.note(*at)
            self.held[at] = self.step(r["key"], r["value"], self.held[at])
            yield Row(key=r["key"], window_start=w["start"], window_end=w["end"], value=self.held[at], ts=r["ts"], seq=r["seq"])

    def flush(self) -> None:
        for at, acc in self.held.items():
            self.state.updateValue(self._at(at), (put(self.kind, acc),))

    def drop(self, key, start: int, end: int, passed: int) -> None:
        self.state.removeKey(self._at((key, start, end)))


def windowed(df: DataFrame, windows: WindowDefinition, grace_ms: int, init: Callable[[], object], step: Callable, kind: str, extractor: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Updates of a windowed table; late records are dropped. Any window definition will do, as a record brings its windows with it."""
    if extractor:
        df = df.withColumn("ts", extractor(F.col("key"), F.col("value")).cast("bigint"))
    fresh = _accepted(df, windows.max_size_ms + grace_ms).withColumn("windows", windows.assign(F.col("ts")))
    made = T._parse_datatype_string(kind)
    schema = T.StructType([*_fields(df, "key"), T.StructField("window_start", _LONG), T.StructField("window_end", _LONG), T.StructField("value", made), *_fields(df, "ts", "seq")])
    return _bucketed(fresh, _Windows(df.schema["key"].dataType, init, step, made, windows.max_size_ms, grace_ms), schema)


class _Sessions(_Swept):
    """Each key's open sessions. A row for each update; retired holds the starts of the sessions that it replaces."""

    def __init__(self, key: T.DataType, gap_ms: int, grace_ms: int, init, step, merge, kind: T.DataType):
        super().__init__(key, gap_ms, 2 * gap_ms + grace_ms)
        self.gap, self.start, self.step, self.merge, self.kind = gap_ms, init, step, merge, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getMapState("sessions", _struct(key=self.key), _struct(open=T.ArrayType(_struct(start=_LONG, end=_LONG, acc=stored(self.kind)))))

    def begin(self) -> None:
        self.held: dict[object, dict[int, list]] = {}

    def _open(self, key) -> dict[int, list]:
        if key not in self.held:
            at = self._at((key,))
            found = self.state.getValue(at)[0] if self.state.containsKey(at) else []
            self.held[key] = {x[0]: [x[1], got(self.kind, x[2])] for x in found}
        return self.held[key]

    def take(self, r: Row) -> Iterator[Row]:
        ts, open_ = r["ts"], self._open(r["key"])
        near = sorted(s for s, (end, _) in open_.items() if end + self.gap >= ts >= s - self.gap)
        acc = open_[near[0]][1] if near else self.start()
        for s in near[1:]:
            acc = self.merge(acc, open_[s][1])
        acc = self.step(r["key"], r["value"], acc)
        first, last = min([ts, *near]), max([ts, *(open_[s][0] for s in near)])
        for s in near:
            del open_[s]
        open_[first] = [last, acc]
        self.note(r["key"], 0, last // self.width * self.width)
        yield Row(key=r["key"], session_start=first, session_end=last, value=acc, retired=[s for s in near if s != first], ts=ts, seq=r["seq"])

    def flush(self) -> None:
        for key, open_ in self.held.items():
            self.state.updateValue(self._at((key,)), ([(s, end, put(self.kind, acc)) for s, (end, acc) in open_.items()],))

    def drop(self, key, start: int, end: int, passed: int) -> None:
        at = self._at((key,))
        if not self.state.containsKey(at):
            return
        entries = [(x[0], x[1], put(stored(self.kind), x[2])) for x in self.state.getValue(at)[0] if x[1] >= passed]
        if entries:
            self.state.updateValue(at, (entries,))
        else:
            self.state.removeKey(at)


def sessions(df: DataFrame, gap_ms: int, grace_ms: int, init: Callable, step: Callable, merge: Callable, kind: str) -> DataFrame:
    made = T._parse_datatype_string(kind)
    schema = T.StructType([*_fields(df, "key"), T.StructField("session_start", _LONG), T.StructField("session_end", _LONG), T.StructField("value", made), T.StructField("retired", T.ArrayType(_LONG)), *_fields(df, "ts", "seq")])
    return _bucketed(_accepted(df, gap_ms + grace_ms), _Sessions(df.schema["key"].dataType, gap_ms, grace_ms, init, step, merge, made), schema)


class _WindowJoin(_Swept):
    """Each side's records by key and slot of time, the last of equal times; a record reads only the slots that its windows reach."""

    def __init__(self, key: T.DataType, value: T.DataType, windows: JoinWindows):
        self.before, self.after, self.value = windows.before_ms + windows.grace_ms, windows.after_ms, value
        # The oldest record that may still come looks so far back.
        super().__init__(key, max(self.before, self.after, 1), windows.max_size_ms + windows.grace_ms + self.before)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        entry = _struct(entries=T.ArrayType(_struct(ts=_LONG, value=stored(self.value))))
        self.sides = [handle.getMapState(n, _struct(key=self.key, slot=_LONG), entry) for n in ("left", "right")]

    def begin(self) -> None:
        self.held: tuple[dict, dict] = ({}, {})
        self.changed: tuple[set, set] = (set(), set())

    def _slot(self, side: int, key, slot: int) -> dict:
        held = self.held[side]
        if (key, slot) not in held:
            state = self.sides[side]
            at = self._at((key, slot))
            held[key, slot] = {t: got(self.value, v) for t, v in state.getValue(at)[0]} if state.containsKey(at) else {}
        return held[key, slot]

    def take(self, r: Row) -> Iterator[Row]:
        key, ts, side = r["key"], r["ts"], r["side"]
        low, high = max(0, ts - self.before), ts + self.after
        for slot in range(low // self.width, high // self.width + 1):
            there = self._slot(1 - side, key, slot)
            for other in sorted(t for t in there if low <= t <= high):
                pair = (r["value"], there[other])
                yield Row(key=key, left=pair[side], right=pair[1 - side], ts=ts, seq=r["seq"], part=r["part"])
        slot = ts // self.width
        self._slot(side, key, slot)[ts] = r["value"]
        self.changed[side].add((key, slot))
        self.note(key, slot, slot * self.width)

    def flush(self) -> None:
        for state, held, changed in zip(self.sides, self.held, self.changed, strict=True):
            for at in changed:
                state.updateValue(self._at(at), ([(t, put(self.value, v)) for t, v in held[at].items()],))

    def drop(self, key, start: int, end: int, passed: int) -> None:
        for state in self.sides:
            if state.containsKey(self._at((key, start))):
                state.removeKey(self._at((key, start)))


def join_streams(left: DataFrame, right: DataFrame, windows: JoinWindows) -> DataFrame:
    """key, left, right, ts, seq, part. Both sides have values of one type; stream time is that of both."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    kind = left.schema["value"].dataType
    schema = T.StructType([*_fields(left, "key"), T.StructField("left", kind), T.StructField("right", kind), *_fields(left, "ts", "seq", "part")])
    return _bucketed(_accepted(both, windows.max_size_ms + windows.grace_ms), _WindowJoin(left.schema["key"].dataType, kind, windows), schema)
