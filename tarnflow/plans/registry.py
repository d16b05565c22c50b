"""All queries of the engine by name, each with its DuckDB equivalent.

Events arrive either by event_id, or late: delayed by up to 4.8 hours by a rule of whole numbers, ties by event_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partitioner import kafka_partition, long_key
from ..functions.serde import JsonSerde
from ..functions.time import millis
from ..operators.streams import Builder, Stream
from ..operators.tables import ColumnFold, Declared, PythonFold
from ..operators.windows import WINDOWS, Hopping, JoinWindows, Session, Tumbling
from ..sources.files import envelope

MINUTE, HOUR = 60_000, 3_600_000
#: The arrival number of a late event is its arrival time since this day, then its id.
DAY_ZERO, IDS = 1_704_067_200_000, 1 << 24
LATE_STRETCH = IDS * MINUTE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# What the oracles share: events with milliseconds and cents, in order of arrival.
_ORDERED = "ev AS (SELECT event_id, user_id, event_type, props, epoch_us(ts)//1000 AS t, CAST(round(value*100) AS BIGINT) AS cents FROM events)"
_LATE = _ORDERED + ", lt AS (SELECT *, row_number() OVER (ORDER BY t + ((event_id*7919)%97)*180000, event_id) AS seq FROM ev), st AS (SELECT *, greatest(0, max(t) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS st FROM lt)"


def query(sql: str):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, late: bool = False, kind: str | None = None, name: str = "events", builder: Builder | None = None) -> Stream:
    """Keyed by user, the value in cents."""
    df = _table(spark, sf_dir, "events")
    if kind:
        df = df.filter(F.col("event_type") == kind)
    seq = F.col("event_id")
    if late:
        delay = (F.col("event_id") * 7919) % 97 * 180_000
        seq = (millis("ts") + delay - DAY_ZERO) * IDS + F.col("event_id")
    rows = envelope(df, F.col("user_id"), F.round(F.col("value") * 100).cast("bigint"), F.col("ts"), seq)
    return (builder or Builder(spark)).stream(name, rows, stretch=LATE_STRETCH if late else 1 << 20)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("key", "value", "ts")


@query("SELECT event_id AS seq, user_id AS key, CAST(round(value*100) AS BIGINT) AS value, epoch_us(ts)//1000 AS ts FROM events WHERE event_type = 'purchase'")
def filter_purchase(spark, sf_dir):
    return events(spark, sf_dir, kind="purchase").df.select("seq", "key", "value", "ts")


@query("SELECT user_id AS key, CAST(round(value*100) AS BIGINT)*3+1 AS value, epoch_us(ts)//1000 AS ts FROM events WHERE CAST(round(value*100) AS BIGINT) > 2000")
def mapvalues_scaled(spark, sf_dir):
    return _shown(events(spark, sf_dir).filter(lambda k, v: v > 2000).map_values(lambda k, v: v * 3 + 1).df)


@query("SELECT user_id % 10 AS key, CAST(round(value*100) AS BIGINT) + user_id AS value, epoch_us(ts)//1000 AS ts FROM events")
def map_rekey(spark, sf_dir):
    return _shown(events(spark, sf_dir).map(lambda k, v: k % 10, lambda k, v: v + k).df)


@query("SELECT user_id AS key, count(*) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def selectkey_count(spark, sf_dir):
    df = _table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    rows = envelope(df, F.col("event_type"), F.struct("user_id"), F.col("ts"), F.col("event_id"))
    return Builder(spark).stream("events", rows).select_key(lambda k, v: v["user_id"]).group_by_key().count().snapshot()


@query("SELECT user_id % 7 AS key, count(*) AS value FROM events GROUP BY 1")
def repartition_count(spark, sf_dir):
    return events(spark, sf_dir).select_key(lambda k, v: k % 7).repartition(8).group_by_key().count().snapshot()


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY 1")
def groupby_count(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().count().snapshot()


@query("SELECT user_id AS key, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1")
def aggregate_sum(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().aggregate(Declared(F.sum)).snapshot()


@query("SELECT user_id AS key, min(CAST(round(value*100) AS BIGINT)) AS low, max(CAST(round(value*100) AS BIGINT)) AS high FROM events GROUP BY 1")
def aggregate_minmax(spark, sf_dir):
    both = Declared(lambda v: F.struct(F.min(v).alias("low"), F.max(v).alias("high")))
    return events(spark, sf_dir).group_by_key().aggregate(both).snapshot().select("key", "value.low", "value.high")


@query("WITH " + _LATE + ", o AS (SELECT user_id, list(cents ORDER BY seq) AS v FROM lt GROUP BY 1) SELECT user_id AS key, list_reduce(list_prepend(CAST(0 AS BIGINT), v), lambda a, x: (a * 31 + x) % 1000003) AS value FROM o")
def aggregate_fold_last(spark, sf_dir):
    fold = ColumnFold(F.lit(0), lambda acc, v: (acc * 31 + v) % 1_000_003, "bigint")
    return events(spark, sf_dir, late=True).group_by_key().aggregate(fold).snapshot()


@query("WITH " + _ORDERED + " SELECT user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value, t AS ts, event_id AS seq FROM ev")
def table_changelog_count(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().count().changelog()


@query("WITH " + _LATE + " SELECT user_id AS key, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value, t AS ts FROM lt")
def table_changelog_sum_late(spark, sf_dir):
    return _shown(events(spark, sf_dir, late=True).group_by_key().aggregate(Declared(F.sum)).changelog())


_COUNTED = "SELECT user_id AS key, s AS window_start, s + {size} AS window_end, count(*) AS value FROM {rows} GROUP BY 1, 2"


@query("WITH " + _ORDERED + ", w AS (SELECT *, (t//3600000)*3600000 AS s FROM ev) " + _COUNTED.format(size=HOUR, rows="w"))
def tumbling_count_1h(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().windowed_by(Tumbling(HOUR)).count().snapshot()


_HOPS = "SELECT *, unnest(generate_series(greatest(0, ((t - 3600000 + 900000)//900000)*900000), (t//900000)*900000, 900000)) AS s FROM {rows}"


@query("WITH " + _ORDERED + ", w AS (" + _HOPS.format(rows="ev") + ") " + _COUNTED.format(size=HOUR, rows="w"))
def hopping_count_1h_15m(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().windowed_by(Hopping(HOUR, 15 * MINUTE)).count().snapshot()


@query("WITH " + _LATE + ", a AS (SELECT * FROM st WHERE t >= st - 3600000 - 7200000), w AS (" + _HOPS.format(rows="a") + ") SELECT user_id AS key, s AS window_start, s + 3600000 AS window_end, CAST(sum(cents) AS BIGINT) AS value FROM w GROUP BY 1, 2")
def hopping_sum_grace(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().windowed_by(Hopping(HOUR, 15 * MINUTE)).with_grace(2 * HOUR).aggregate(Declared(F.sum)).snapshot()


@query("WITH " + _ORDERED + ", w AS (SELECT *, ((cents*1000)//3600000)*3600000 AS s, greatest(0, max(cents*1000) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS st FROM ev) SELECT user_id % 5 AS key, s AS window_start, s + 3600000 AS window_end, count(*) AS value FROM w WHERE cents*1000 >= st - 3600000 - 360000000 GROUP BY 1, 2")
def window_extractor(spark, sf_dir):
    keyed = events(spark, sf_dir).select_key(lambda k, v: k % 5).group_by_key()
    return keyed.windowed_by(Tumbling(HOUR)).with_grace(100 * HOUR).with_timestamp_extractor(lambda k, v: v * 1000).count().snapshot()


@query("WITH " + _LATE + ", w AS (SELECT *, (t//3600000)*3600000 AS s FROM st WHERE t >= st - 3600000) " + _COUNTED.format(size=HOUR, rows="w"))
def tumbling_late_drop(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().windowed_by(Tumbling(HOUR)).count().snapshot()


@query("WITH " + _LATE + ", w AS (SELECT *, (t//3600000)*3600000 AS s FROM st WHERE t >= st - 3600000 - 7200000) " + _COUNTED.format(size=HOUR, rows="w"))
def tumbling_grace_late_drop(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().windowed_by(Tumbling(HOUR)).with_grace(2 * HOUR).count().snapshot()


@query("WITH " + _LATE + ", w AS (SELECT *, (t//3600000)*3600000 AS s FROM st WHERE t >= st - 3600000) SELECT user_id AS key, s AS window_start, count(*) OVER (PARTITION BY user_id, s ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value, t AS ts FROM w")
def tumbling_changelog(spark, sf_dir):
    log = events(spark, sf_dir, late=True).group_by_key().windowed_by(Tumbling(HOUR)).count().changelog()
    return log.select("key", "window_start", "value", "ts")


@query("WITH " + _LATE + " SELECT CAST(sum(CAST(t < st - 3600000 AS INT)) AS BIGINT) AS late_count FROM st")
def late_count(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().windowed_by(Tumbling(HOUR)).late_count()


@query("WITH " + _LATE + ", p AS (SELECT *, user_id % 4 AS part FROM lt), q AS (SELECT *, greatest(0, max(t) OVER (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS st FROM p) SELECT CAST(sum(CAST(t < st - 3600000 AS INT)) AS BIGINT) AS late_count FROM q")
def late_count_by_task(spark, sf_dir):
    stream = events(spark, sf_dir, late=True)
    stream = stream._with(stream.df.withColumn("part", F.pmod("key", F.lit(4)).cast("int")))
    return stream.group_by_key().windowed_by(Tumbling(HOUR)).late_count()


_ISLANDS = "i AS (SELECT *, sum(CASE WHEN t - p > {gap} OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {rows})) SELECT user_id AS key, min(t) AS session_start, max(t) AS session_end, {value} AS value FROM i GROUP BY user_id, sid"


@query("WITH " + _ORDERED + ", " + _ISLANDS.format(gap=30 * MINUTE, rows="ev", value="count(*)"))
def session_count_30m(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().session_windowed_by(Session(30 * MINUTE)).count()


@query("WITH " + _ORDERED + ", " + _ISLANDS.format(gap=12 * HOUR, rows="ev", value="count(*)"))
def session_count_12h(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().session_windowed_by(Session(12 * HOUR)).count()


@query("WITH " + _ORDERED + ", " + _ISLANDS.format(gap=12 * HOUR, rows="ev", value="CAST(sum(cents) AS BIGINT)"))
def session_sum(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().session_windowed_by(Session(12 * HOUR)).aggregate(F.sum("value"))


@query("WITH " + _LATE + ", a AS (SELECT * FROM st WHERE t >= st - 3600000 - 3600000), " + _ISLANDS.format(gap=HOUR, rows="a", value="count(*)"))
def session_grace(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().session_windowed_by(Session(HOUR)).with_grace(HOUR).count()


@query("WITH " + _LATE + " SELECT CAST(sum(CAST(t < st - 3600000 - 3600000 AS INT)) AS BIGINT) AS late_count FROM st")
def session_late_count(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().session_windowed_by(Session(HOUR)).with_grace(HOUR).late_count()


def _customers(spark: SparkSession, sf_dir: str) -> Stream:
    df = _table(spark, sf_dir, "customer")
    rows = envelope(df, F.col("c_custkey"), F.struct("c_name", "c_nationkey"), F.lit(0).cast("bigint"), F.col("c_custkey"))
    return Builder(spark).stream("customer", rows)


@query("SELECT c_custkey AS key, c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_global_customer_nation(spark, sf_dir):
    stream, nations = _customers(spark, sf_dir), _table(spark, sf_dir, "nation")
    table = stream.builder.global_table("nation", nations.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit(0).alias("seq")))
    out = stream.join_global(table, lambda k, v: v["c_nationkey"], lambda v, g: F.struct(v["c_name"].alias("customer"), g.alias("nation")))
    return out.df.select("key", "value.*")


@query("SELECT c_custkey AS key, c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def join_global_miss(spark, sf_dir):
    """A null value deletes a key of the global table, so lookups of other regions' nations miss."""
    stream, nations = _customers(spark, sf_dir), _table(spark, sf_dir, "nation")
    kept = nations.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit(0).alias("seq"))
    gone = nations.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("seq"))
    table = stream.builder.global_table("nation", kept.unionByName(gone))
    out = stream.join_global(table, lambda k, v: v["c_nationkey"], lambda v, g: F.struct(v["c_name"].alias("customer"), g.alias("nation")))
    return out.df.select("key", "value.*")


@query("SELECT o_orderkey AS key, o_orderstatus AS status, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_global_orders_customer(spark, sf_dir):
    rows = envelope(_table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.struct("o_custkey", "o_orderstatus"), F.col("o_orderdate"), F.col("o_orderkey"))
    stream = Builder(spark).stream("orders", rows)
    table = stream.builder.global_table("customer", _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).alias("seq")))
    out = stream.join_global(table, lambda k, v: v["o_custkey"], lambda v, g: F.struct(v["o_orderstatus"].alias("status"), g.alias("segment")))
    return out.df.select("key", "value.*")


@query("WITH " + _LATE + ", p AS (SELECT user_id, seq, count(*) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM lt WHERE event_type = 'purchase') SELECT v.user_id AS key, v.t AS ts, (SELECT max(n) FROM p WHERE p.user_id = v.user_id AND p.seq < v.seq) AS value FROM lt v WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM p WHERE p.user_id = v.user_id AND p.seq < v.seq)")
def join_table_asof(spark, sf_dir):
    b = Builder(spark)
    purchases = events(spark, sf_dir, late=True, kind="purchase", name="purchases", builder=b).group_by_key().count()
    views = events(spark, sf_dir, late=True, kind="view", name="views", builder=b)
    return _shown(views.join_table(purchases, lambda v, n: n).df)


def _ss(sql_before: int, sql_after: int, grace: int, dup: str = "t") -> str:
    """Both sides by arrival, late ones out, the last of equal (user, time) only until the next."""
    low = sql_before + grace
    return (
        "WITH " + _LATE.split(", st AS")[0] + f", s AS (SELECT user_id, event_type, cents, seq, {dup} AS t FROM lt WHERE event_type IN ('view', 'purchase')), "
        "x AS (SELECT *, greatest(0, max(t) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS st FROM s), "
        f"a AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY user_id, event_type, t ORDER BY seq), 9223372036854775807) AS until FROM x WHERE t >= st - {sql_before + sql_after + grace}), "
        "l AS (SELECT * FROM a WHERE event_type = 'view'), r AS (SELECT * FROM a WHERE event_type = 'purchase') "
        "SELECT l.user_id AS key, l.cents AS left_cents, r.cents AS right_cents, CASE WHEN l.seq > r.seq THEN l.t ELSE r.t END AS ts FROM l JOIN r ON l.user_id = r.user_id AND "
        f"((l.seq > r.seq AND l.seq < r.until AND r.t BETWEEN greatest(0, l.t - {low}) AND l.t + {sql_after}) OR (r.seq > l.seq AND r.seq < l.until AND l.t BETWEEN greatest(0, r.t - {low}) AND r.t + {sql_after}))"
    )


def _joined(spark: SparkSession, sf_dir: str, windows: JoinWindows, coarse: int = 0) -> DataFrame:
    b = Builder(spark)
    views, purchases = (events(spark, sf_dir, late=True, kind=k, name=k, builder=b) for k in ("view", "purchase"))
    if coarse:
        views, purchases = (s._with(s.df.withColumn("ts", F.col("ts") - F.col("ts") % coarse)) for s in (views, purchases))
    out = views.join(purchases, lambda l, r: F.struct(l.alias("left_cents"), r.alias("right_cents")), windows)
    return out.df.select("key", "value.*", "ts")


@query(_ss(12 * HOUR, 12 * HOUR, 0))
def ssjoin_symmetric(spark, sf_dir):
    return _joined(spark, sf_dir, JoinWindows(12 * HOUR, 12 * HOUR))


@query(_ss(0, 12 * HOUR, 0))
def ssjoin_asymmetric(spark, sf_dir):
    return _joined(spark, sf_dir, JoinWindows(0, 12 * HOUR))


@query(_ss(3 * HOUR, HOUR, 2 * HOUR))
def ssjoin_grace(spark, sf_dir):
    return _joined(spark, sf_dir, JoinWindows(3 * HOUR, HOUR, 2 * HOUR))


@query(_ss(24 * HOUR, 24 * HOUR, 0, "(t//43200000)*43200000"))
def ssjoin_dup_ts(spark, sf_dir):
    """Event times cut to half days, so that users have several events of one time."""
    return _joined(spark, sf_dir, JoinWindows(24 * HOUR, 24 * HOUR), 12 * HOUR)


class MonthHalves:
    """A custom assigner: the first and the second half of January 2024, and the whole of it."""

    max_size_ms = 31 * 24 * HOUR

    def assign(self, ts):
        half = DAY_ZERO + 15 * 24 * HOUR
        end = DAY_ZERO + self.max_size_ms
        window = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"))
        return F.array(F.when(ts < half, window(DAY_ZERO, half)).otherwise(window(half, end)), window(DAY_ZERO, end)).cast(WINDOWS)


_HALF = DAY_ZERO + 15 * 24 * HOUR
_END = DAY_ZERO + 31 * 24 * HOUR


@query(f"WITH {_ORDERED}, w AS (SELECT user_id, CASE WHEN t < {_HALF} THEN {DAY_ZERO} ELSE {_HALF} END AS s, CASE WHEN t < {_HALF} THEN {_HALF} ELSE {_END} END AS e FROM ev UNION ALL SELECT user_id, {DAY_ZERO}, {_END} FROM ev) SELECT user_id AS key, CAST(s AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, count(*) AS value FROM w GROUP BY 1, 2, 3")
def custom_window_assigner(spark, sf_dir):
    return events(spark, sf_dir).group_by_key().windowed_by(MonthHalves()).count().snapshot()


@query("WITH " + _ORDERED + ", r AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC) AS n FROM ev) SELECT user_id AS key, CAST(sum(cents) AS BIGINT) AS value FROM r WHERE n <= 3 GROUP BY 1")
def topk_via_aggregate(spark, sf_dir):
    """A fold that keeps the three largest values; shown by their sum."""
    fold = ColumnFold(F.array(), lambda acc, v: F.slice(F.reverse(F.array_sort(F.concat(acc, F.array(v)))), 1, 3), "array<bigint>")
    top = events(spark, sf_dir).group_by_key().aggregate(fold).snapshot()
    return top.select("key", F.aggregate("value", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("value"))


@query("SELECT user_id AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_serde_props(spark, sf_dir):
    rows = envelope(_table(spark, sf_dir, "events"), F.col("user_id"), F.col("props").cast("binary"), F.col("ts"), F.col("event_id"))
    stream = Builder(spark).stream("events", rows, value_serde=JsonSerde("k bigint"))
    return stream.df.groupBy("key", F.col("value.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS key, concat('{\"cents\":', CAST(round(value*100) AS BIGINT), '}') AS value FROM events WHERE event_type = 'signup'")
def sink_json_encoded(spark, sf_dir):
    """A sink's rows as they are written: the value encoded."""
    b = Builder(spark)
    events(spark, sf_dir, kind="signup", builder=b).map_values(lambda k, v: F.struct(v.alias("cents"))).to("out", value_serde=JsonSerde("cents bigint"))
    return b.build()["out"].select("key", F.col("value").cast("string").alias("value"))


@query("SELECT event_type AS key, count(*) AS value FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def merge_count(spark, sf_dir):
    b = Builder(spark)
    clicks, errors = (_named(events(spark, sf_dir, kind=k, name=k, builder=b), k) for k in ("click", "error"))
    return clicks.merge(errors).group_by_key().count().snapshot()


@query("WITH " + _LATE + ", o AS (SELECT user_id, list(cents ORDER BY seq) AS v FROM lt GROUP BY 1) SELECT user_id AS key, list_reduce(list_prepend(CAST(7 AS BIGINT), v), lambda a, x: (a * 33 + x) % 1000003) AS value FROM o")
def python_fold_last(spark, sf_dir):
    fold = PythonFold(lambda: 7, lambda key, value, acc: (acc * 33 + value) % 1_000_003, "bigint")
    return events(spark, sf_dir, late=True).group_by_key().aggregate(fold).snapshot()


_RUNNING = "WITH " + _LATE + ", o AS (SELECT user_id, seq, t, list(cents) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS v FROM lt) SELECT user_id AS key, list_reduce(list_prepend(CAST(7 AS BIGINT), v), lambda a, x: (a * 33 + x) % 1000003) AS value, t AS ts FROM o"


@query(_RUNNING)
def python_fold_changelog(spark, sf_dir):
    fold = PythonFold(lambda: 7, lambda key, value, acc: (acc * 33 + value) % 1_000_003, "bigint")
    return _shown(events(spark, sf_dir, late=True).group_by_key().aggregate(fold).changelog())


@query(_RUNNING)
def column_fold_changelog(spark, sf_dir):
    fold = ColumnFold(F.lit(7), lambda acc, v: (acc * 33 + v) % 1_000_003, "bigint")
    return _shown(events(spark, sf_dir, late=True).group_by_key().aggregate(fold).changelog())


@query("WITH " + _LATE + ", a AS (SELECT * FROM st WHERE t >= st - 3600000 - 3600000), " + _ISLANDS.format(gap=HOUR, rows="a", value="CAST(sum(cents) AS BIGINT)"))
def session_fold_sum(spark, sf_dir):
    """A fold with a merge of the sessions that a late record bridges."""
    sessions = events(spark, sf_dir, late=True).group_by_key().session_windowed_by(Session(HOUR)).with_grace(HOUR)
    return sessions.fold(lambda: 0, lambda key, value, acc: acc + value, lambda a, b: a + b, "bigint")


@query("WITH " + _LATE + ", a AS (SELECT * FROM st WHERE t >= st - 43200000 - 3600000), " + _ISLANDS.format(gap=12 * HOUR, rows="a", value="max(cents)").replace(" AS value FROM i", " AS value, min(cents) AS low, count(*) AS n FROM i"))
def session_fold_struct(spark, sf_dir):
    """Sessions with a value of several fields."""
    sessions = events(spark, sf_dir, late=True).group_by_key().session_windowed_by(Session(12 * HOUR)).with_grace(HOUR)
    step = lambda key, v, acc: (max(acc[0], v), min(acc[1], v), acc[2] + 1) if acc else (v, v, 1)
    merge = lambda a, b: (max(a[0], b[0]), min(a[1], b[1]), a[2] + b[2])
    out = sessions.fold(lambda: None, step, merge, "struct<top:bigint,low:bigint,n:bigint>")
    return out.select("key", "session_start", "session_end", F.col("value.top").alias("value"), "value.low", "value.n")


_BOTH = "WITH " + _LATE.split(", st AS")[0] + ", s AS (SELECT * FROM lt WHERE event_type IN ('view', 'purchase')), x AS (SELECT *, greatest(0, max(t) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS st FROM s) SELECT CAST(sum(CAST(t < st - {reach} AS INT)) AS BIGINT) AS late_count FROM x"


@query(_BOTH.format(reach=4 * HOUR))
def join_late_count(spark, sf_dir):
    b = Builder(spark)
    views, purchases = (events(spark, sf_dir, late=True, kind=k, name=k, builder=b) for k in ("view", "purchase"))
    return views.late_in_join(purchases, JoinWindows(HOUR, HOUR, 2 * HOUR))


@query("WITH " + _LATE + " SELECT CAST(sum(CAST(t < st - 5400000 AS INT)) AS BIGINT) AS late_count FROM st")
def hopping_late_count(spark, sf_dir):
    return events(spark, sf_dir, late=True).group_by_key().windowed_by(Hopping(HOUR, 15 * MINUTE)).with_grace(30 * MINUTE).late_count()


# murmur2 of a long's eight bytes, the high word of which is zero here: two words, read from the other end.
_L = "4294967295"
_MURMUR = (
    "WITH k AS (SELECT DISTINCT CAST(user_id AS UBIGINT) AS u, user_id FROM events), "
    "w AS (SELECT user_id, ((u & 255) << 24) | (((u >> 8) & 255) << 16) | (((u >> 16) & 255) << 8) | ((u >> 24) & 255) AS k2 FROM k), "
    f"a AS (SELECT user_id, (CAST({0x9747B28C ^ 8} AS UBIGINT) * 1540483477) & {_L} AS h, (k2 * 1540483477) & {_L} AS k2 FROM w), "
    f"b AS (SELECT user_id, ((h * 1540483477) & {_L}) AS h, (xor(k2, k2 >> 24) * 1540483477) & {_L} AS k2 FROM a), "
    "c AS (SELECT user_id, xor(h, k2) AS h FROM b), "
    f"d AS (SELECT user_id, (xor(h, h >> 13) * 1540483477) & {_L} AS h FROM c) "
    "SELECT user_id AS key, CAST((xor(h, h >> 15) & 2147483647) % 12 AS INTEGER) AS partition FROM d"
)


@query(_MURMUR)
def kafka_partition_of_keys(spark, sf_dir):
    keys = events(spark, sf_dir).df.select("key").distinct()
    return keys.select("key", kafka_partition(long_key(F.col("key")), 12).alias("partition"))


@query("SELECT user_id % 10 AS key, count(*) AS value FROM events WHERE CAST(round(value*100) AS BIGINT) > 2000 GROUP BY 1")
def map_rekey_count(spark, sf_dir):
    """A changed key needs no repartition by hand."""
    return events(spark, sf_dir).filter(lambda k, v: v > 2000).map(lambda k, v: k % 10, lambda k, v: v).group_by_key().count().snapshot()


@query("WITH " + _ORDERED + ", p AS (SELECT event_id, user_id % 50 AS k FROM ev WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id % 50 AS k, t FROM ev WHERE event_type = 'view') SELECT v.k AS key, v.t AS ts, (SELECT count(*) FROM p WHERE p.k = v.k AND p.event_id < v.event_id) AS value FROM v WHERE EXISTS (SELECT 1 FROM p WHERE p.k = v.k AND p.event_id < v.event_id)")
def join_table_after_rekey(spark, sf_dir):
    """Both sides re-keyed and dealt out to different numbers of partitions: they meet all the same."""
    b = Builder(spark)
    rekeyed = lambda kind: events(spark, sf_dir, kind=kind, name=kind, builder=b).select_key(lambda k, v: k % 50)
    table = rekeyed("purchase").repartition(3).group_by_key().count()
    return _shown(rekeyed("view").repartition(5).join_table(table, lambda v, n: n).df)


@query("SELECT o_orderkey AS key, o_orderstatus AS status, l AS last FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def join_global_last_value(spark, sf_dir):
    """A key that occurs several times in a global table has its last value, here by ship date."""
    rows = envelope(_table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_orderkey"))
    stream = Builder(spark).stream("orders", rows)
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("value"), millis("l_shipdate").alias("seq"))
    out = stream.join_global(stream.builder.global_table("lines", lines), lambda k, v: k, lambda v, g: F.struct(v.alias("status"), g.alias("last")))
    return out.df.select("key", "value.*")


def _named(stream: Stream, name: str) -> Stream:
    return stream.select_key(lambda k, v: F.lit(name))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
