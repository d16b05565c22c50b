"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of the whole text are embedded; filters of WIDTH bytes move over them in steps of STEP, so that neighbouring
windows overlap; windows are max-pooled over chunks of CHUNK bytes, whose last windows reach into the next chunk; the
largest and the mean of the chunks' pools are combined into one probability. It is trained with Adam on the driver on
at most SAMPLE different labelled texts of each class of at most SAMPLE_BYTES bytes, those with the least hash: labels
are joined to such documents first, then repeats go, then the sample is taken. Scores read nothing but the text; a long
one goes through the network in slices of SLICE bytes, of which only the pools' maximum and sum are kept.

Null and empty texts are one chunk of padding and have the score of that. Labels other than 0 and 1, and documents
without labels, teach nothing; labels that contradict each other both count; without labels of both classes every score
is 0.5. Repeated rows have equal scores,
null doc_ids are not held out, an empty table gives no rows, other columns of the labels or documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, free_name, kept, pieces, table, tidy

STEP, TAPS, CHUNK = 4, 3, 256
WIDTH = STEP * TAPS
EMBED, FILTERS = 6, 24
WINDOWS = CHUNK // STEP
#: The bound of the sample that the network learns from: documents of each class, and bytes of a document.
SAMPLE, SAMPLE_BYTES = 1000, 32_768
EPOCHS, BATCH, RATE, SEED = 16, 32, 0.01, 7
#: Bytes that go through the network at once; a multiple of CHUNK.
SLICE = 1 << 18
THRESHOLD = 0.3
#: The share of passages among what is learnt from, and their least bytes.
CUT, CUT_LEAST = 0.3, 20


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED, the last row is padding
    filters: np.ndarray  # STEP * EMBED x TAPS * FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: np.ndarray

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        embed[256] = 0
        filters = r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (STEP * EMBED, TAPS * FILTERS)).astype(np.float32)
        return cls(embed, filters, np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole chunks with a filter's reach of padding at least; the chunks of each text."""
    chunks = np.array([-(-(len(t) + WIDTH - STEP) // CHUNK) for t in texts])
    out = np.full(int(chunks.sum()) * CHUNK + WIDTH, 256, dtype=np.int16)
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]]) * CHUNK
    for at, t in zip(starts.tolist(), texts, strict=True):
        out[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return out, chunks


def forward(net: Network, texts: list[bytes]) -> tuple[np.ndarray, dict]:
    """The log-odds of each text, and what backward needs."""
    flat, chunks = laid_out(texts)
    rows = net.embed[flat].reshape(-1, STEP * EMBED)
    taps = rows @ net.filters
    n = int(chunks.sum()) * WINDOWS
    z = taps[:n, :FILTERS] + net.bias
    for k in range(1, TAPS):
        z += taps[k : n + k, k * FILTERS : (k + 1) * FILTERS]
    ends = np.cumsum(chunks) * WINDOWS
    for k in range(1, TAPS):
        z[ends - k] = -1e9  # these windows begin in the padding and reach into the next text
    z = z.reshape(-1, WINDOWS, FILTERS)
    pools = np.maximum(z.max(axis=1), 0)
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    most = np.maximum.reduceat(pools, starts, axis=0)
    mean = np.add.reduceat(pools, starts, axis=0) / chunks[:, None]
    features = np.concatenate([most, mean], axis=1)
    return features @ net.weights + net.offset[0], {"flat": flat, "rows": rows, "z": z, "pools": pools, "chunks": chunks, "most": most, "features": features}


def backward(net: Network, kept: dict, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of the parts, for the loss's slope at each log-odds."""
    chunks, z, pools = kept["chunks"], kept["z"], kept["pools"]
    doc = np.repeat(np.arange(len(chunks)), chunks)
    of_features = slope[:, None] * net.weights
    of_pools = of_features[doc, FILTERS:] / chunks[doc, None]
    top = pools == kept["most"][doc]
    ties = np.add.reduceat(top.astype(np.float32), np.concatenate([[0], np.cumsum(chunks)[:-1]]), axis=0)
    of_pools = of_pools + of_features[doc, :FILTERS] * top / ties[doc]
    of_pools *= pools > 0
    window = z.argmax(axis=1) + np.arange(len(z))[:, None] * WINDOWS
    chunk, f = np.nonzero(of_pools)
    g, at = of_pools[chunk, f].astype(np.float32), window[chunk, f]
    of_filters, of_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    flat = kept["flat"]
    for k in range(TAPS):
        by_filter = np.zeros((FILTERS, STEP * EMBED), np.float32)
        np.add.at(by_filter, f, kept["rows"][at + k] * g[:, None])
        of_filters[:, k * FILTERS : (k + 1) * FILTERS] = by_filter.T
        back = (net.filters[:, k * FILTERS + f].T * g[:, None]).reshape(-1, STEP, EMBED)
        for j in range(STEP):
            np.add.at(of_embed, flat[(at + k) * STEP + j], back[:, j])
    of_embed[256] = 0
    return [of_embed, of_filters, np.bincount(f, g, FILTERS).astype(np.float32), (slope @ kept["features"]).astype(np.float32), np.array([slope.sum()], np.float32)]


def _cut(text: bytes, r: np.random.Generator) -> bytes:
    """Now and then a passage instead of the whole, as most texts are long, but short ones are to be judged as well."""
    if r.random() > CUT:
        return text
    n = int(np.exp(r.uniform(np.log(6), np.log(400)))) + CUT_LEAST
    at = int(r.integers(0, max(1, len(text) - n)))
    at = text.rfind(b" ", 0, at) + 1
    return text[at : at + n]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network | None:
    """None if there is but one class."""
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    net, r = Network.new(), np.random.default_rng(SEED)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    batches = -(-len(texts) // BATCH)
    rounds = max(epochs, -(-250 // batches))  # few documents need more rounds
    step, steps = 0, rounds * batches
    for _ in range(rounds):
        order = r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            odds, kept = forward(net, [_cut(texts[i], r) for i in some])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            slope = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, (part, grad) in enumerate(zip(net.parts(), backward(net, kept, slope), strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                part -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return net


def long_odds(net: Network, text: bytes) -> float:
    """The log-odds of a text of any length, slice by slice. A slice has the few bytes after it as well, as its last windows reach into them."""
    most, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
    for at in range(0, len(text), SLICE):
        pools = forward(net, [text[at : at + SLICE + WIDTH - STEP]])[1]["pools"]
        if at + SLICE < len(text):
            pools = pools[: SLICE // CHUNK]
        most, total, chunks = np.maximum(most, pools.max(axis=0)), total + pools.sum(axis=0, dtype=np.float64), chunks + len(pools)
    return float(np.concatenate([most, total / chunks]) @ net.weights + net.offset[0])


def probabilities(net: Network | None, texts: list[str | None]) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    data = [(t or "").encode() for t in texts]
    odds = np.zeros(len(data))
    short = [i for i, t in enumerate(data) if len(t) <= SLICE]
    if short:
        odds[short] = forward(net, [data[i] for i in short])[0]
    for i, t in enumerate(data):
        if len(t) > SLICE:
            odds[i] = long_odds(net, t)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text (bytes), quality: at most SAMPLE different texts of each class, without the held-out rows. Only ids and hashes are joined and ranked; the texts picked are read after that."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).distinct()
    usable = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).withColumn("key", F.xxhash64("text"))
    found = usable.select("id", "key").join(marked, F.col("id") == F.col("doc_id")).groupBy("quality", "key").agg(F.min("id").alias("picked"))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("key"), "key"))
    picked = kept(found.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).select("picked", F.col("key").alias("picked_key"), "quality"), "labelled")
    # At most SAMPLE rows of each class are broadcast.
    return usable.join(F.broadcast(picked), (F.col("id") == F.col("picked")) & (F.col("key") == F.col("picked_key"))).select("text", "quality").distinct()


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Learns from docs (doc_id, text) and labels (doc_id, quality), without the held-out rows."""
    rows = sorted(sample(docs, labels).collect(), key=lambda r: (bytes(r["text"]), r["quality"]))  # at most twice SAMPLE
    return train([bytes(r["text"]) for r in rows], np.array([r["quality"] for r in rows]))


def scored(docs: DataFrame, net: Network | None, columns: list[str], name: str = "score") -> DataFrame:
    """The columns of docs named, and the score of each text."""
    arrow_rows(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(name, T.DoubleType())])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", SLICE):
                p = probabilities(net, batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(p)], names=[*columns, name])

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(tidy(each), schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns whatever their names."""
    net, name = fit(docs, labels), free_name(docs)
    return scored(docs, net, docs.columns, name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
