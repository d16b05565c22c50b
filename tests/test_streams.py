"""Bounded operators against hand-computed cases and the sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow import testing
from tarnflow.config import Config, Guarantee
from tarnflow.functions.partitioner import kafka_partition, murmur2
from tarnflow.functions.serde import BytesSerde, JsonSerde, ProtoSerde
from tarnflow.operators.lateness import with_stream_time
from tarnflow.operators.streams import Builder
from tarnflow.operators.tables import ColumnFold, Declared, PythonFold
from tarnflow.operators.windows import WINDOWS, Hopping, JoinWindows, Session, Tumbling
from tarnflow.sources.files import envelope, read_parquet, validated
from tarnflow.testing import TestDriver


def stream(spark, records, builder=None, name="s", value="string", stretch=3):
    """records: (key, value, ts[, seq])"""
    rows = [(*r[:3], r[3] if len(r) > 3 else i, 0) for i, r in enumerate(records)]
    return (builder or Builder(spark)).stream(name, spark.createDataFrame(rows, f"key string, value {value}, ts bigint, seq bigint, part int"), stretch=stretch)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_filter_map_mapvalues_through_the_driver(spark):
    def topology(b, s):
        kept = s["in"].filter(lambda k, v: v.startswith("hello")).map(lambda k, v: F.concat(k, F.lit("!")), lambda k, v: F.length(v))
        kept.map_values(lambda k, v: F.concat(v, F.lit(" chars"))).to("out")

    d = TestDriver(spark, {"in": "string, string"}, topology)
    d.pipe("in", "a", "world", 5)
    d.pipe("in", "b", "hello", 7)
    assert d.read("out") == [("b!", "5 chars", 7)] and d.read("out") == []
    d.pipe("in", "c", "hello!", 8)
    assert d.read("out") == [("c!", "6 chars", 8)] and len(d.peek("out")) == 2


def test_builder_rules(spark):
    b = Builder(spark)
    with pytest.raises(ValueError, match="no source"):
        b.build()
    s = stream(spark, [("a", "x", 1)], b)
    with pytest.raises(ValueError, match="no sink"):
        b.build()
    with pytest.raises(ValueError, match="taken"):
        stream(spark, [("a", "x", 1)], b)
    s.to("o").to("p")
    assert set(b.build()) == {"o", "p"}
    with pytest.raises(ValueError, match="lacks"):
        b.stream("q", spark.range(1))
    with pytest.raises(ValueError):
        s.repartition(-1)


def test_counts_folds_and_changelogs(spark):
    s = stream(spark, [("a", "x", 1), ("b", "yy", 2), ("a", "zzz", 3), ("a", "", 4)])
    assert rows(s.group_by_key().count().snapshot(), "key", "value") == [("a", 3), ("b", 1)]
    assert rows(s.group_by_key().count().changelog(), "seq", "key", "value", "ts") == [(0, "a", 1, 1), (1, "b", 1, 2), (2, "a", 2, 3), (3, "a", 3, 4)]
    for how in (Declared(lambda v: F.sum(F.length(v))), ColumnFold(F.lit(0), lambda acc, v: acc + F.length(v), "bigint"), PythonFold(lambda: 0, lambda k, v, acc: acc + len(v), "bigint")):
        t = s.group_by_key().aggregate(how)
        assert rows(t.snapshot(), "key", "value") == [("a", 4), ("b", 2)]
        assert rows(t.changelog(), "seq", "value") == [(0, 1), (1, 2), (2, 4), (3, 4)]
    order = ColumnFold(F.lit(""), lambda acc, v: F.concat(acc, v), "string")
    shuffled = stream(spark, [("a", "3", 1, 30), ("a", "1", 9, 10), ("a", "2", 5, 20)])
    assert rows(shuffled.group_by_key().aggregate(order).snapshot(), "value") == [("123",)]
    assert rows(s.select_key(lambda k, v: F.upper(k)).repartition(3).group_by_key().count().snapshot(), "key", "value") == [("A", 3), ("B", 1)]


def test_table_sink(spark, tmp_path):
    s = stream(spark, [("a", "x", 1), ("a", "y", 2)])
    s.group_by_key().count().to(str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "key", "value") == [("a", 1), ("a", 2)]
    s.to("o", value_serde=JsonSerde("string"))
    s.builder.run(str(tmp_path / "b"))
    assert [bytes(r[0]) for r in rows(spark.read.parquet(str(tmp_path / "b" / "o")), "value")] == [b'"x"', b'"y"']


@pytest.mark.parametrize(
    ("windows", "ts", "starts"),
    [
        (Tumbling(10_000), 0, [0]), (Tumbling(10_000), 12_000, [10_000]), (Tumbling(10_000), 10_000, [10_000]), (Tumbling(10_000), -5_000, [0]),
        (Hopping(10_000, 5_000), 12_000, [5_000, 10_000]), (Hopping(10_000, 5_000), 4_000, [0]), (Hopping(10_000, 5_000), 5_000, [0, 5_000]), (Hopping(10_000, 5_000), 0, [0]),
        (Hopping(30_000, 10_000), 25_000, [0, 10_000, 20_000]), (Hopping(25_000, 10_000), 25_000, [10_000, 20_000]), (Hopping(10_000, 5_000), -1, []),
    ],
)
def test_window_starts(spark, windows, ts, starts):
    got = spark.range(1).select(windows.assign(F.lit(ts).cast("bigint")).cast(WINDOWS).alias("w")).first()["w"]
    assert [(w["start"], w["end"]) for w in got] == [(s, s + windows.max_size_ms) for s in starts]


def test_bad_windows():
    for bad in (lambda: Tumbling(0), lambda: Hopping(10, 0), lambda: Hopping(10, 11), lambda: Session(0), lambda: JoinWindows(-1, 0)):
        with pytest.raises(ValueError):
            bad()


def windowed(spark, times, windows, grace=0):
    w = stream(spark, [("k", "v", t) for t in times]).group_by_key().windowed_by(windows).with_grace(grace)
    return rows(w.count().snapshot(), "window_start", "value"), w.late_count().first()[0]


def test_late_records(spark):
    assert windowed(spark, [5000, 15000, 25000, 12000, 3000], Tumbling(10_000), 5000) == ([(0, 1), (10_000, 2), (20_000, 1)], 1)
    assert windowed(spark, [50_000, 1000], Tumbling(10_000)) == ([(50_000, 1)], 1)
    assert windowed(spark, [20_000, 10_000], Tumbling(10_000)) == ([(10_000, 1), (20_000, 1)], 0)


def sessions(spark, times, gap, grace=0):
    w = stream(spark, [("k", "v", t) for t in times]).group_by_key().session_windowed_by(Session(gap)).with_grace(grace)
    return rows(w.count(), "session_start", "session_end", "value"), w.late_count().first()[0]


def test_sessions(spark):
    assert sessions(spark, [1000, 5000, 9000], 10_000) == ([(1000, 9000, 3)], 0)
    assert sessions(spark, [20_000, 30_000, 60_000, 70_000], 15_000, 30_000) == ([(20_000, 30_000, 2), (60_000, 70_000, 2)], 0)
    assert sessions(spark, [20_000, 30_000, 60_000, 70_000, 45_000], 15_000, 30_000) == ([(20_000, 70_000, 5)], 0)
    assert sessions(spark, [100_000, 80_000], 10_000, 5_000) == ([(100_000, 100_000, 1)], 1)
    assert sessions(spark, [0, 10_001], 10_000) == ([(0, 0, 1), (10_001, 10_001, 1)], 0)


def test_session_fold_with_a_merge_that_has_no_identity(spark):
    w = stream(spark, [("k", "v", t) for t in (1000, 50_000, 30_000)]).group_by_key().session_windowed_by(Session(30_000)).with_grace(30_000)
    got = w.fold(lambda: 100, lambda k, v, acc: acc + 1, min, "bigint")
    assert rows(got, "session_start", "session_end", "value") == [(1000, 50_000, 102)]


def ss(spark, arrivals, windows):
    b = Builder(spark)
    sides = [[(r[1], r[2], r[3], i) for i, r in enumerate(arrivals) if r[0] == side] for side in "LR"]
    left, right = (stream(spark, x, b, n) if x else b.stream(n, spark.createDataFrame([], "key string, value string, ts bigint, seq bigint, part int")) for n, x in zip("LR", sides, strict=True))
    out = left.join(right, lambda l, r: F.concat(l, F.lit(":"), r), windows)
    return rows(out.df, "key", "value", "ts"), left.late_in_join(right, windows).first()[0]


W = JoinWindows(50, 50)


@pytest.mark.parametrize(
    ("arrivals", "windows", "want"),
    [
        ([("L", "k", "l", 100), ("R", "k", "r", 120)], W, [("k", "l:r", 120)]),
        ([("L", "k", "l", 100), ("R", "k", "r", 200)], W, []),
        ([("R", "k", "1", 90), ("R", "k", "2", 95), ("L", "k", "l", 100)], W, [("k", "l:1", 100), ("k", "l:2", 100)]),
        ([("L", "x", "l", 1000), ("R", "k", "r", 900), ("L", "k", "l", 901)], JoinWindows(10, 10), []),
        ([("L", "k", "l", 5), ("R", "k", "r", 10)], JoinWindows(0, 10), []),
        ([("R", "k", "r", 10), ("L", "k", "l", 5)], JoinWindows(0, 10), [("k", "l:r", 5)]),
        ([("R", "k", "r", 49), ("L", "k", "l", 100)], JoinWindows(50, 50, 10), [("k", "l:r", 100)]),
        ([("R", "k", "r", 39), ("L", "k", "l", 100)], JoinWindows(50, 50, 10), []),
        ([("L", "k", "l", 100), ("R", "k", "r", 100)], W, [("k", "l:r", 100)]),
        ([("R", "k", "old", 100), ("R", "k", "new", 100), ("L", "k", "l", 100)], W, [("k", "l:new", 100)]),
        ([("R", "k", "r", 2**63 - 1), ("L", "k", "l", 2**63 - 101)], JoinWindows(50, 200), [("k", "l:r", 2**63 - 101)]),
        ([("L", "k", "l", 0), ("R", "k", "r", 0)], JoinWindows(100, 100), [("k", "l:r", 0)]),
    ],
)
def test_stream_joins(spark, arrivals, windows, want):
    assert ss(spark, arrivals, windows)[0] == want


@pytest.mark.parametrize(("b", "match"), [(100, True), (50, True), (49, False), (150, True), (151, False)])
def test_join_bounds(spark, b, match):
    assert bool(ss(spark, [("R", "k", "r", b), ("L", "k", "l", 100)], W)[0]) == match


def test_joins_with_tables(spark):
    b = Builder(spark)
    table = stream(spark, [("k", "", 0, i) for i in range(3)], b, "t").group_by_key().count()
    s = stream(spark, [("k", "v", 9, 5), ("miss", "v", 9, 6)], b, "s")
    assert rows(s.join_table(table, lambda v, n: F.concat(v, F.lit(":"), n)).df, "key", "value", "ts") == [("k", "v:3", 9)]
    early = stream(spark, [("k", "v", 9, -1)], b, "early")
    assert rows(early.join_table(table, lambda v, n: n).df, "key") == []
    same = stream(spark, [("k", "v", 9, 0)], b, "same")
    assert rows(same.join_table(table, lambda v, n: n).df, "value") == [(1,)]
    assert rows(same.join_table(table, lambda v, n: n, table_first=False).df, "value") == []
    g = b.global_table("g", spark.createDataFrame([("x", "old", 0), ("x", "new", 1), ("y", "y", 0), ("y", None, 2)], "key string, value string, seq bigint"))
    o = stream(spark, [("o1", "x", 1), ("o2", "y", 2), ("o3", "z", 3)], b, "o")
    assert rows(o.join_global(g, lambda k, v: v, lambda v, x: x).df, "key", "value") == [("o1", "new")]
    with pytest.raises(ValueError):
        o.join_table(o.group_by_key().windowed_by(Tumbling(10)).count(), lambda v, n: n)


def arrivals(seed, n=400):
    r = random.Random(seed)
    return [(f"k{r.randrange(6)}", r.randrange(100), max(0, i * 3 + r.randrange(-60, 20))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_arrivals_match_the_sequential_model(spark, seed):
    data = arrivals(seed)
    g = stream(spark, data, value="bigint", stretch=37).group_by_key()
    w = g.windowed_by(Hopping(40, 15)).with_grace(5)
    want, late = testing.windowed(data, lambda ts: [(s, s + 40) for s in range(max(0, (ts - 40 + 15) // 15 * 15), ts + 1, 15)], 45, lambda: 0, lambda k, v, acc: (acc * 31 + v) % 1009)
    fold = ColumnFold(F.lit(0), lambda acc, v: (acc * 31 + v) % 1009, "bigint")
    assert {tuple(r)[:3]: r["value"] for r in w.aggregate(fold).snapshot().select("key", "window_start", "window_end", "value").collect()} == want
    assert w.late_count().first()[0] == late > 0
    s = g.session_windowed_by(Session(4)).with_grace(30)
    want, late = testing.sessions(data, 4, 30, lambda: 0, lambda k, v, acc: acc + 1, lambda a, b: a + b)
    assert {tuple(r)[:3]: r["value"] for r in s.count().collect()} == want and s.late_count().first()[0] == late > 0
    want, _ = testing.sessions(data, 4, 30, lambda: 7, lambda k, v, acc: (acc * 3 + v) % 101, lambda a, b: a - 2 * b)
    got = s.fold(lambda: 7, lambda k, v, acc: (acc * 3 + v) % 101, lambda a, b: a - 2 * b, "bigint")
    assert {tuple(r)[:3]: r["value"] for r in got.collect()} == want


@pytest.mark.parametrize("windows", [JoinWindows(20, 20), JoinWindows(0, 30, 5), JoinWindows(15, 3, 10)])
def test_random_joins_match_the_sequential_model(spark, windows):
    r = random.Random(windows.after_ms)
    data = [(r.randrange(2), *x) for x in arrivals(9)]
    b = Builder(spark)
    sides = [stream(spark, [(k, v, t, i) for i, (s, k, v, t) in enumerate(data) if s == side], b, f"s{side}", "bigint", 50) for side in (0, 1)]
    out = sides[0].join(sides[1], lambda l, r: F.struct(l.alias("l"), r.alias("r")), windows)
    got = sorted((x["key"], x["value"]["l"], x["value"]["r"], x["ts"]) for x in out.df.collect())
    assert got == sorted(testing.joined(data, windows)) and got


def test_stream_time_per_task(spark):
    data = [(ts, i, i % 2) for i, ts in enumerate([5, 100, 3, 50, 9, 200])]
    got = with_stream_time(spark.createDataFrame(data, "ts bigint, seq bigint, part int"), 2).orderBy("seq").collect()
    assert [r["stream_time"] for r in got] == [5, 100, 5, 100, 9, 200]


def test_serdes(spark):
    cases = [("struct<a:int,b:array<string>>", '{"a":1,"b":["x"]}'), ("map<string,int>", '{"k":1}'), ("array<bigint>", "[1,2]"), ("int", "7"), ("int", "null"), ("string", '"x\\"}y"')]
    for kind, text in cases:
        serde = JsonSerde(kind)
        df = spark.createDataFrame([(text.encode(),)], "raw binary").select(serde.decode(F.col("raw")).alias("v"))
        assert bytes(df.select(serde.encode(F.col("v"))).first()[0]).decode() == text
    bad = spark.createDataFrame([(b"{not json",)], "raw binary").select(JsonSerde("a int").decode(F.col("raw")).alias("v"))
    with pytest.raises(Exception, match="(?i)malformed"):
        bad.collect()
    assert bytes(spark.createDataFrame([(b"\x00\xff",)], "raw binary").select(BytesSerde().decode(F.col("raw"))).first()[0]) == b"\x00\xff"
    with pytest.raises(TypeError):
        ProtoSerde(int, "a int")


def test_proto_round_trip(spark):
    wrappers = pytest.importorskip("google.protobuf.wrappers_pb2")
    serde = ProtoSerde(wrappers.StringValue, "value string")
    df = spark.createDataFrame([(("hello",),)], "v struct<value:string>")
    packed = df.select(serde.encode(F.col("v")).alias("raw"))
    assert bytes(packed.first()[0]) == wrappers.StringValue(value="hello").SerializeToString()
    assert packed.select(serde.decode(F.col("raw")).alias("v")).first()["v"]["value"] == "hello"


def test_partitions_of_keys(spark):
    known = {b"": 0x106E08D9, b"a": 0xA2D0B27C, b"hello": 0x7F1DDBBD, b"test": 0x2AB0E07F}
    assert {k: murmur2(k) for k in known} == known
    df = spark.createDataFrame([(b"hello",)], "k binary").select(kafka_partition(F.col("k"), 6))
    assert df.first()[0] == (0x7F1DDBBD & 0x7FFFFFFF) % 6


def test_config():
    c = Config("app", ("x",)).validated()
    assert (c.commit_interval_ms, c.guarantee) == (100, Guarantee.AT_LEAST_ONCE)
    with pytest.raises(ValueError, match="application_id.*sources.*commit_interval"):
        Config(commit_interval_ms=-1).validated()


def test_sources(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, name string")
    assert validated(df, df.schema) is df
    with pytest.raises(ValueError, match="name int"):
        from pyspark.sql import types as T

        validated(df, T._parse_datatype_string("name int"))
    events = read_parquet(spark, "/root/testdata/sf0.001/events.parquet")
    e = envelope(events, F.col("user_id"), F.col("value"), F.col("ts"), F.col("event_id"))
    assert e.columns == ["key", "value", "ts", "seq", "part"] and dict(e.dtypes)["ts"] == "bigint"


def test_plans(spark):
    """Filters and columns reach the scan; a small global table is broadcast; no operator gathers rows in one partition."""
    from tarnflow.plans import registry

    plan = lambda name: registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan("selectkey_count")
    assert "ReadSchema: struct<user_id:bigint>" in plan("groupby_count") or "struct<user_id:bigint>" in plan("groupby_count")
    for name in ("tumbling_grace_late_drop", "ssjoin_grace"):
        # Only the maxima of stretches of arrivals meet in one place.
        assert plan(name).split("== Physical Plan ==")[1].count("Exchange SinglePartition") <= 1
    assert "Exchange SinglePartition" not in plan("join_table_asof")


def test_murmur2_of_many_keys_at_once(spark):
    import random

    from tarnflow.functions.partitioner import long_key, murmur2_all

    r = random.Random(1)
    keys = [bytes(r.randrange(256) for _ in range(n)) for n in range(40) for _ in range(3)]
    assert murmur2_all(keys).tolist() == [murmur2(k) for k in keys] and murmur2_all([]).tolist() == []
    df = spark.createDataFrame([(5,), (-1,), (None,)], "k bigint").select("k", kafka_partition(long_key(F.col("k")), 6).alias("p"))
    want = {k: (murmur2(k.to_bytes(8, "big", signed=True)) & 0x7FFFFFFF) % 6 for k in (5, -1)} | {None: None}
    assert {x["k"]: x["p"] for x in df.collect()} == want


def test_partitions_of_a_join():
    from tarnflow.sources.files import copartitioned

    assert copartitioned({"a": 3, "b": 3}) == 3
    with pytest.raises(ValueError, match="a has 3, b has 4"):
        copartitioned({"a": 3, "b": 4})
    with pytest.raises(ValueError, match="missing topics: b"):
        copartitioned({"a": 3, "b": 0})


def test_folds_of_a_large_key(spark):
    """A changelog folds a key once: 40,000 rows of one key, by columns and by Python, against a loop."""
    import time

    n = 40_000
    df = spark.range(n).select(F.lit("k").alias("key"), ((F.col("id") * 7919) % 1000).alias("value"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.lit(0).alias("part"))
    want, acc = [], 7
    for i in range(n):
        acc = (acc * 33 + i * 7919 % 1000) % 1_000_003
        want.append(acc)
    for fold in (ColumnFold(F.lit(7), lambda acc, v: (acc * 33 + v) % 1_000_003, "bigint"), PythonFold(lambda: 7, lambda k, v, acc: (acc * 33 + v) % 1_000_003, "bigint")):
        began = time.time()
        table = Builder(spark).stream("s", df).group_by_key().aggregate(fold)
        assert [r["value"] for r in table.changelog().orderBy("seq").collect()] == want
        assert [tuple(r) for r in table.snapshot().collect()] == [("k", want[-1])]
        assert time.time() - began < 40


def test_python_folds_of_keys_with_nulls(spark):
    data = [(None, 1, 0, 0), ("a", 2, 1, 1), (None, 3, 2, 2), ("a", None, 3, 3), ("b", 5, 4, 4)]
    df = spark.createDataFrame(data, "key string, value bigint, ts bigint, seq bigint")
    table = Builder(spark).stream("s", df).group_by_key().aggregate(PythonFold(list, lambda k, v, acc: [*acc, v], "array<bigint>"))
    assert {r["key"]: r["value"] for r in table.snapshot().collect()} == {None: [1, 3], "a": [2, None], "b": [5]}
    assert [(r["seq"], r["value"]) for r in table.changelog().orderBy("seq").collect()] == [(0, [1]), (1, [2]), (2, [1, 3]), (3, [2, None]), (4, [5])]
    empty = Builder(spark).stream("s", df.limit(0)).group_by_key().aggregate(PythonFold(list, lambda k, v, acc: acc, "array<bigint>"))
    assert empty.snapshot().collect() == empty.changelog().collect() == []


def test_state_folders(spark):
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    assert Config("app", ("x",), state_dir="s3://b/x").state_folder(cluster) == "s3://b/x"
    with pytest.raises(ValueError, match="state_dir must name a folder"):
        Config("app", ("x",)).state_folder(cluster)
    cluster.conf.get = lambda *a: "hdfs:///shared/"
    assert Config("app", ("x",)).state_folder(cluster) == "hdfs:///shared/tarnflow-app"
    assert Config("app", ("x",)).state_folder(spark)
