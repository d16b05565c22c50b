"""Shared plumbing of the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to a Python worker; texts are long, so the default of 10,000 is too many.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one, but only
    if all runs on this machine: on a cluster each executor would write to a disk of its own, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; the master is {master}")
        at = f"file://{tempfile.mkdtemp(prefix='tarnflow-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it goes when the application ends."""
    at = f"{shared_dir(spark)}/tarnflow/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)


#: The most bits of a sieve, 16 MB.
SIEVE_BITS = 1 << 27


def sieve(keys: DataFrame) -> np.ndarray:
    """A Bloom filter, as unsigned 64-bit words, of keys (key long): 16 bits for each, as far as SIEVE_BITS go. It is bounded, and only
    spares rows a shuffle that they don't need: a join decides, so that a full sieve costs time but no rows."""
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))
    place = F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    rows = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # a row for each word at most
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def sieved(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be among those of the sieve."""
    keys, mask = keys.view(np.uint64), np.uint64(64 * len(words) - 1)
    held = [(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) for at in (keys & mask, (keys >> np.uint64(32)) & mask)]
    return (held[0] & held[1]).astype(bool)


def free_name(df: DataFrame, name: str = "made") -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Plans read this setting of the session when they run, so it stays as the operators leave it: small. Raised only around what runs at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """each, that gives memory it has freed back to the system when a task ends: workers are used again, and an executor has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of the column, one row at least."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([x or 0 for x in pc.binary_length(text).to_pylist()], dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    at = 0
    for to in [*cuts.tolist(), batch.num_rows]:
        if to > at:
            yield batch.slice(at, to - at)
        at = to
