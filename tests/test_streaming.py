"""Unbounded operators over a folder of files, in several micro-batches and restarts, against the sequential model."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnflow import testing
from tarnflow.config import Config, Guarantee
from tarnflow.operators.streams import Builder
from tarnflow.operators.tables import PythonFold
from tarnflow.operators.windows import Hopping, JoinWindows, Session, Tumbling
from tarnflow.sources.files import stream_parquet
from tarnflow.streaming import exact, native, runner

SCHEMA = "key string, value bigint, ts bigint, seq bigint, part int"


def data(seed=1, n=120):
    r = random.Random(seed)
    return [(f"k{r.randrange(4)}", r.randrange(100), max(0, i * 3 + r.randrange(-60, 20)), i, 0) for i in range(n)]


def put(spark, folder, rows, batches=2):
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, name, build, rows, guarantee=Guarantee.AT_LEAST_ONCE):
    """Half of the rows, a stop, and then the rest."""
    config = Config("test", ("files",), guarantee=guarantee, state_dir=str(tmp_path / "state"))
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        put(spark, tmp_path / "in", part, 1)
        df = build(stream_parquet(spark, str(tmp_path / "in"), SCHEMA, 1))
        runner.finish(runner.start(df, name, str(tmp_path / "out"), config, once=True))
    return spark.read.parquet(str(tmp_path / "out"))


def test_changelog_and_restart(spark, tmp_path):
    rows = data()
    got = run(spark, tmp_path, "count", lambda df: exact.changelog(df, lambda: 0, lambda k, v, acc: acc + 1, "bigint"), rows)
    seen, want = {}, []
    for k, _, ts, seq, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        want.append((seq, k, seen[k], ts))
    assert sorted((r["seq"], r["key"], r["value"], r["ts"]) for r in got.collect()) == want
    held = runner.state(spark, str(tmp_path / "state" / "count"), "table").select("key.*", "value.*").collect()
    assert {r[0]: int(r[1]) for r in held} == seen


def test_windows_with_grace(spark, tmp_path):
    rows = data(2)
    got = run(spark, tmp_path, "w", lambda df: exact.windowed(df, Hopping(40, 15), 5, lambda: 0, lambda k, v, acc: (acc * 31 + v) % 1009, "bigint"), rows)
    want, late = testing.windowed([r[:3] for r in rows], lambda ts: [(s, s + 40) for s in range(max(0, (ts - 40 + 15) // 15 * 15), ts + 1, 15)], 45, lambda: 0, lambda k, v, acc: (acc * 31 + v) % 1009)
    last = got.groupBy("key", "window_start", "window_end").agg(F.max_by("value", "seq").alias("v"))
    assert {tuple(r)[:3]: r["v"] for r in last.collect()} == want and late


def test_sessions(spark, tmp_path):
    rows = data(3)
    step, merge = (lambda k, v, acc: (acc * 3 + v) % 101), (lambda a, b: a - 2 * b)
    got = run(spark, tmp_path, "s", lambda df: exact.sessions(df, 4, 30, lambda: 7, step, merge, "bigint"), rows)
    want, _ = testing.sessions([r[:3] for r in rows], 4, 30, lambda: 7, step, merge)
    live = {}
    for r in got.orderBy("seq").collect():
        for s in r["retired"]:
            live.pop((r["key"], s), None)
        live[r["key"], r["session_start"]] = (r["session_end"], r["value"])
    assert {(k, s, e): v for (k, s), (e, v) in live.items()} == want


def test_joins(spark, tmp_path):
    rows, w = data(4), JoinWindows(15, 3, 10)
    side = lambda df, s: df.filter(F.col("value") % 2 == s)
    got = run(spark, tmp_path, "j", lambda df: exact.join_streams(side(df, 0), side(df, 1), w), rows)
    want = testing.joined([(v % 2, k, v, ts) for k, v, ts, _, _ in rows], w)
    assert sorted((r["key"], r["left"], r["right"], r["ts"]) for r in got.collect()) == sorted(want) and want


def test_table_join_exactly_once(spark, tmp_path):
    rows = data(5)
    table = lambda df: df.filter("value < 30")
    got = run(spark, tmp_path, "t", lambda df: exact.join_table(df.filter("value >= 30"), table(df), lambda: 0, lambda k, v, acc: acc + 1, "bigint"), rows, Guarantee.EXACTLY_ONCE)
    seen, want = {}, []
    for k, v, _, seq, _ in rows:
        if v < 30:
            seen[k] = seen.get(k, 0) + 1
        elif k in seen:
            want.append((seq, k, seen[k]))
    assert sorted((r["seq"], r["key"], r["table_value"]) for r in got.collect()) == want


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    write = runner.replayable(str(tmp_path / "o"))
    for n in (0, 1, 1):
        write(spark.range(5), n)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10


def test_native_forms_agree_where_nothing_is_late(spark, tmp_path):
    rows = sorted(data(6), key=lambda r: r[2])
    rows = [(k, v, ts, i, p) for i, (k, v, ts, _, p) in enumerate(rows)] + [("end", 0, 10_000, 999, 0)]
    put(spark, tmp_path / "in", rows, 1)
    read = lambda: stream_parquet(spark, str(tmp_path / "in"), SCHEMA)
    for name, df, want in (
        ("w", native.windowed_count(read(), Tumbling(40)), testing.windowed([r[:3] for r in rows[:-1]], lambda ts: [(ts // 40 * 40, ts // 40 * 40 + 40)], 40, lambda: 0, lambda k, v, a: a + 1)[0]),
        ("s", native.session_count(read(), Session(4)), testing.sessions([r[:3] for r in rows[:-1]], 4, 0, lambda: 0, lambda k, v, a: a + 1, lambda a, b: a + b)[0]),
    ):
        q = df.writeStream.format("memory").queryName(f"native_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        runner.finish(q)
        assert {tuple(r)[:3]: r[3] for r in spark.table(f"native_{name}").filter("key <> 'end'").collect()} == want
    with pytest.raises(ValueError):
        native.join_streams(read(), read(), JoinWindows(1, 2))


def test_errors_and_metrics_reach_the_caller(spark, tmp_path):
    metrics = runner.Metrics()
    spark.streams.addListener(metrics)
    put(spark, tmp_path / "in", data(7, 10), 1)

    def bad(k, v, acc):
        raise RuntimeError("step failed")

    config = Config("test", ("files",), state_dir=str(tmp_path / "state"))
    df = exact.changelog(stream_parquet(spark, str(tmp_path / "in"), SCHEMA), lambda: 0, bad, "bigint")
    with pytest.raises(Exception, match="step failed"):
        runner.finish(runner.start(df, "bad", str(tmp_path / "out"), config, once=True))
    good = stream_parquet(spark, str(tmp_path / "in"), SCHEMA).filter("value >= 0")
    runner.finish(runner.start(good, "good", str(tmp_path / "good"), config, once=True))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(metrics)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 10


def api(df):
    return Builder(df.sparkSession).stream("in", df)


MIX = PythonFold(lambda: 0, lambda k, v, acc: (acc * 31 + v) % 1009, "bigint")


class Thirds:
    """A custom definition: the third of a hundred that a time is in, and the hundred."""

    max_size_ms = 100

    def assign(self, ts):
        low = ts - ts % 100
        third = low + F.floor((ts % 100) / 34).cast("bigint") * 34
        window = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
        return F.array(window(third, F.least(third + 34, low + 100)), window(low, low + 100))


def thirds(ts):
    low = ts - ts % 100
    third = low + ts % 100 // 34 * 34
    return [(third, min(third + 34, low + 100)), (low, low + 100)]


def test_the_same_calls_over_an_unbounded_stream(spark, tmp_path):
    """Custom windows, an extractor and grace, by the chainable API, against the bounded form and the sequential model."""
    rows = data(8, 80)
    build = lambda df: api(df).filter(lambda k, v: v >= 10).group_by_key().windowed_by(Thirds()).with_grace(7).with_timestamp_extractor(lambda k, v: v * 3).aggregate(MIX).changelog()
    got = run(spark, tmp_path, "custom", build, rows)
    kept = [(k, v, v * 3) for k, v, *_ in rows if v >= 10]
    want, late = testing.windowed(kept, thirds, 107, MIX.init, MIX.step)
    last = got.groupBy("key", "window_start", "window_end").agg(F.max_by("value", "seq").alias("v"))
    assert {tuple(r)[:3]: r["v"] for r in last.collect()} == want and late
    bounded = build(spark.createDataFrame(rows, SCHEMA))
    columns = ["key", "window_start", "window_end", "value", "ts", "seq"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, bounded.select(*columns).collect()))


def test_late_counts(spark, tmp_path):
    rows = data(9)
    w = JoinWindows(5, 5, 2)
    build = lambda df: api(df).group_by_key().windowed_by(Tumbling(10)).with_grace(3).late_count()
    got = run(spark, tmp_path / "w", "late", build, rows).agg(F.max("late_count")).first()[0]
    assert got == build(spark.createDataFrame(rows, SCHEMA)).first()[0] > 0
    both = lambda df: (api(df.filter("value < 50")), api(df.filter("value >= 50")))
    build = lambda df: both(df)[0].late_in_join(both(df)[1], w)
    got = run(spark, tmp_path / "j", "late", build, rows).agg(F.max("late_count")).first()[0]
    assert got == build(spark.createDataFrame(rows, SCHEMA)).first()[0] > 0


def test_joins_by_the_api(spark, tmp_path):
    rows, w = data(10), JoinWindows(15, 3, 10)
    sides = lambda df: (api(df.filter("value % 2 = 0")), api(df.filter("value % 2 = 1")))
    joined = lambda df: sides(df)[0].join(sides(df)[1], lambda l, r: l * 1000 + r, w).df
    table = lambda df: sides(df)[0].join_table(sides(df)[1].group_by_key().count(), lambda v, n: v * 1000 + n).df
    for name, build in (("streams", joined), ("table", table)):
        got = run(spark, tmp_path / name, name, build, rows)
        want = build(spark.createDataFrame(rows, SCHEMA)).select("key", "value", "ts")
        assert sorted(map(tuple, got.select("key", "value", "ts").collect())) == sorted(map(tuple, want.collect())), name
        assert want.count()


def test_global_table_that_changes(spark, tmp_path):
    """Odd values change or (below 20) delete the entry of a key of another name; even ones look up a key from their value."""
    rows = data(11, 200)
    name = lambda v: F.concat(F.lit("g"), (v % 5).cast("string"))

    def build(df):
        b = Builder(df.sparkSession)
        changes = df.filter("value % 2 = 1").select(name(F.col("value")).alias("key"), F.when(F.col("value") >= 20, F.col("value")).alias("value"), "seq")
        return b.stream("in", df.filter("value % 2 = 0")).join_global(b.global_table("g", changes), lambda k, v: name(v), lambda v, g: v * 1000 + g).df

    got = run(spark, tmp_path, "g", build, rows)
    held, want = {}, []
    for k, v, ts, seq, _ in rows:
        if v % 2:
            held[v % 5] = v if v >= 20 else None
        elif held.get(v % 5) is not None:
            want.append((seq, k, v * 1000 + held[v % 5], ts))
    assert sorted((r["seq"], r["key"], r["value"], r["ts"]) for r in got.collect()) == want and want
    # A bounded table is looked up as it is.
    static = spark.createDataFrame([("g2", 7, 0), ("g2", 8, 1), ("g3", None, 2)], "key string, value bigint, seq bigint")

    def lookup(df):
        b = Builder(df.sparkSession)
        return b.stream("in", df).join_global(b.global_table("g", static), lambda k, v: name(v), lambda v, g: v * 1000 + g).df

    got = run(spark, tmp_path / "static", "s", lookup, rows)
    assert sorted((r["seq"], r["value"]) for r in got.collect()) == [(seq, v * 1000 + 8) for k, v, ts, seq, _ in rows if v % 5 == 2]


@pytest.mark.parametrize("kind", ["windows", "sessions", "join"])
def test_a_key_that_stops_leaves_no_state(spark, tmp_path, monkeypatch, kind):
    """Keys come once and never again, while others go on: their state goes as the stream time passes."""
    monkeypatch.setattr(exact, "BUCKETS", 2)
    rows = [(f"k{i // 4}", i % 4, i * 10, i, 0) for i in range(400)]
    one = lambda k, v, acc: acc + 1
    build, variable, operator = {
        "windows": (lambda df: exact.windowed(df, Tumbling(50), 20, lambda: 0, one, "bigint"), "windows", 1),
        "sessions": (lambda df: exact.sessions(df, 15, 20, lambda: 0, one, lambda a, b: a + b, "bigint"), "sessions", 1),
        "join": (lambda df: exact.join_streams(df.filter("value % 2 = 0"), df.filter("value % 2 = 1"), JoinWindows(15, 15, 5)), "left", 1),
    }[kind]
    run(spark, tmp_path, kind, build, rows)
    numbers = {}
    for op in (0, 1):
        try:
            numbers[op] = runner.state(spark, str(tmp_path / "state" / kind), variable, op).count()
        except Exception:  # the variable is the other operator's
            continue
    assert len(numbers) == 1 and 0 < min(numbers.values()) < 20, numbers
    # What is left is of the last stretch of time; a late revival starts anew.
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 100


def test_state_has_types(spark, tmp_path):
    """Bytes, decimals, dates, structs, lists and maps with whole numbers as keys come back as what they were."""
    kind = "struct<n:bigint,raw:binary,price:decimal(10,2),day:date,last:array<bigint>,seen:map<bigint,string>>"
    day = datetime.date(2024, 1, 1)

    def step(k, v, acc):
        n, raw, price, at, last, seen = acc or (0, b"", Decimal("0.00"), day, [], {})
        assert isinstance(bytes(raw), bytes) and isinstance(price, Decimal) and isinstance(at, datetime.date) and all(isinstance(x, int) for x in seen)
        return (n + 1, bytes(raw) + bytes([v]), price + Decimal(v) / 4, at + datetime.timedelta(days=1), [*last, v][-3:], {**seen, v: "x"})

    rows = data(12, 40)
    got = run(spark, tmp_path, "typed", lambda df: exact.changelog(df, lambda: None, step, kind), rows)
    want, held = {}, {}
    for k, v, _, seq, _ in rows:
        held[k] = step(k, v, held.get(k))
        want[seq] = held[k]
    for r in got.collect():
        x = r["value"]
        assert (x["n"], bytes(x["raw"]), x["price"], x["day"], x["last"], x["seen"]) == (want[r["seq"]][0], want[r["seq"]][1], want[r["seq"]][2].quantize(Decimal("0.01")), *want[r["seq"]][3:])


def test_topologies_start_as_they_are_built(spark, tmp_path):
    rows = data(13, 60)
    put(spark, tmp_path / "in", rows, 2)
    b = Builder(spark)
    s = b.stream("in", stream_parquet(spark, str(tmp_path / "in"), SCHEMA, 1))
    s.filter(lambda k, v: v > 50).to("large")
    s.map_values(lambda k, v: v + 1).to("more")
    config = Config("test", ("files",), state_dir=str(tmp_path / "state"))
    for q in runner.start_all(b, str(tmp_path / "out"), config, once=True).values():
        runner.finish(q)
    assert spark.read.parquet(str(tmp_path / "out" / "large")).count() == sum(r[1] > 50 for r in rows)
    assert spark.read.parquet(str(tmp_path / "out" / "more")).count() == 60
    b = Builder(spark)
    b.stream("in", spark.createDataFrame(rows, SCHEMA)).to("x")
    with pytest.raises(ValueError, match="bounded"):
        runner.start_all(b, str(tmp_path / "o"), config)
    with pytest.raises(ValueError, match="snapshot"):
        s.group_by_key().count().snapshot()
    with pytest.raises(ValueError, match="PythonFold"):
        from tarnflow.operators.tables import Declared

        s.group_by_key().aggregate(Declared(F.max)).changelog()
