"""Streams from Parquet tables and folders, bounded and unbounded, and a thin adapter for Kafka."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import millis

#: Of a topic; offsets times this are unique over partitions.
MOST_PARTITIONS = 1 << 16


def validated(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """df, if it has the fields of the schema; a missing or different field is an error at the start, not in the middle."""
    if schema is not None:
        kinds = dict(df.dtypes)
        wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if kinds.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"the source lacks {', '.join(wrong)}")
    return df


def envelope(df: DataFrame, key: Column, value: Column, ts: Column, seq: Column, part: Column | None = None) -> DataFrame:
    """key, value, ts, seq, part. ts: a timestamp, or milliseconds."""
    kind = df.select(ts.alias("t")).schema["t"].dataType
    ms = ts.cast("bigint") if isinstance(kind, T.LongType | T.IntegerType) else millis(ts)
    return df.select(key.alias("key"), value.alias("value"), ms.alias("ts"), seq.cast("bigint").alias("seq"), (F.lit(0) if part is None else part.cast("int")).alias("part"))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return validated(spark.read.parquet(path), schema)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """An unbounded read of a folder. The schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def copartitioned(partitions: Mapping[str, int]) -> int:
    """The number of partitions that all topics of a join have; topics of unequal numbers, or none, are an error before the start."""
    if missing := sorted(t for t, n in partitions.items() if n <= 0):
        raise ValueError(f"missing topics: {', '.join(missing)}")
    if len(set(partitions.values())) != 1:
        raise ValueError("unequal partitions: " + ", ".join(f"{t} has {n}" for t, n in sorted(partitions.items())))
    return next(iter(partitions.values()))


def stream_kafka(spark: SparkSession, brokers: str, topic: str, committed_only: bool = True, **options: str) -> DataFrame:
    """key and value as bytes, ts, seq from the offset and the partition (unique, and in order within each), part from the partition. Needs Spark's Kafka connector; untested without it."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    if committed_only:
        reader = reader.option("kafka.isolation.level", "read_committed")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select("key", "value", F.unix_millis("timestamp").alias("ts"), (F.col("offset") * MOST_PARTITIONS + F.col("partition")).alias("seq"), F.col("partition").alias("part"))
