"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on the driver on about SAMPLE distinct vectors, and every vector is sent down to a leaf. A query
walks the tree through a priority queue, nearest centre first, and visits the next leaves in that order. How many it
visits is widened until the recall on CALIBRATION vectors, against brute force over all vectors, reaches RECALL (all
leaves reach 1). Visits and vectors meet by leaf; vectors and visits of a leaf are cut into blocks of about BLOCK by the leaf's
own counts, and each block of vectors meets each block of visits in a cell of its own. A cell gives the nearest few of
each query with exact cosines in double precision, ties to the smaller id, and the nearest of all cells are ranked.

Equal vectors are searched once: they keep their few smallest ids, so that copies, ties and hot vectors cost no more
than a row, and equal queries share one search. Vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most frequent one. Fewer candidates than k give all of
them. An empty table, or one without queries, gives no rows. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

K, EVERY = 5, 50
#: The bound of the sample that the tree is fitted on, and of that which calibrates the visits.
SAMPLE, CALIBRATION = 60_000, 128
BRANCHES, ROUNDS, SEED = 16, 8, 11
#: Leaves grow in number with the root of the vectors, so that neither visits nor a visit's work grow as fast as these; LEAF is the fewest of the sample that a leaf is fitted on.
LEAVES, LEAF = 0.75, 16
RECALL = 0.95
#: Vectors of a leaf that one block holds, visits likewise; and cosines that a task holds at once.
BLOCK, HELD = 16_384, 4_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """children[i] of node i: first and number, or none for a leaf, whose number is leaf[i]; centres are unit vectors."""

    centres: np.ndarray
    first: np.ndarray
    number: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        node = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if self.leaf[n] >= 0 or not len(rows):
                node[rows] = self.leaf[n]
                continue
            a, k = self.first[n], self.number[n]
            best = (x[rows] @ self.centres[a : a + k].T).argmax(axis=1)
            todo += [(int(a + j), rows[best == j]) for j in range(k)]
        return node

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first traversal for a unit vector."""
        heap = [(0.0, 0)]
        while heap:
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                yield int(self.leaf[n])
                continue
            a, k = int(self.first[n]), int(self.number[n])
            for j, s in enumerate((self.centres[a : a + k] @ q).tolist()):
                heapq.heappush(heap, (-s, a + j))


def kmeans(x: np.ndarray, k: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[r.choice(len(x), k, replace=False)].copy()
    best = None
    for _ in range(ROUNDS):
        now = (x @ centres.T).argmax(axis=1)
        if best is not None and (now == best).all():
            break
        best = now
        for j in range(k):
            mine = x[best == j]
            if len(mine):
                c = mine.sum(axis=0)
                centres[j] = c / max(1e-12, np.sqrt(c @ c))
    used, best = np.unique((x @ centres.T).argmax(axis=1), return_inverse=True)
    return centres[used], best


def grow(x: np.ndarray, most: int = 48) -> Tree:
    """From unit vectors, one at least; leaves are of most of them or fewer."""
    r = np.random.default_rng(SEED)
    centres, first, number, leaf = [x.mean(axis=0)], [0], [0], [-1]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        n, rows = todo.pop()
        parts = kmeans(x[rows], min(BRANCHES, -(-len(rows) // most)), r) if len(rows) > most else None
        if parts is None or len(parts[0]) < 2:
            leaf[n] = leaves
            leaves += 1
            continue
        first[n], number[n] = len(centres), len(parts[0])
        for j, c in enumerate(parts[0]):
            todo.append((len(centres), rows[parts[1] == j]))
            centres.append(c)
            first.append(0)
            number.append(0)
            leaf.append(-1)
    return Tree(np.array(centres), np.array(first), np.array(number), np.array(leaf))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit of a cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of rows of q and c, summed in one fixed order."""
    q, c = _scaled(q), _scaled(c)
    return (q * c).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((c * c).sum(axis=-1)))


def _nearest(q: np.ndarray, c: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, cosine) of each query's k nearest, ties to the smaller id; all within rounding of the k-th are weighed exactly."""
    unit, other = _unit(q), _unit(c).T
    step = max(1, HELD // max(1, len(c)))
    for at in range(0, len(q), step):
        for i, row in enumerate(unit[at : at + step] @ other, at):
            some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-12) if len(row) > k else np.arange(len(row))
            exact = _cosines(q[i], c[some])
            for j in np.lexsort((least[some], -exact))[:k]:
                yield i, int(some[j]), float(exact[j])


def _brute_force(distinct: DataFrame, probes: np.ndarray, k: int) -> list[list[np.ndarray]]:
    """The k nearest distinct vectors of each probe: each task gives its own k, Spark merges them."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            held.append((_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)))
            c, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            found = list(_nearest(probes, c, ids, k))
            rows = sorted({j for _, j, _ in found})
            held = [(c[rows], ids[rows])]
        if held and len(held[0][1]):
            c, ids = held[0]
            i, j, s = zip(*_nearest(probes, c, ids, k), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s), pa.array([c[x].tolist() for x in j], pa.list_(pa.float64()))], names=["q", "s", "v"])

    found = distinct.select("v", F.col("ids")[0].alias("least")).mapInArrow(each, "q long, s double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
    out: list[list[np.ndarray]] = [[] for _ in probes]
    for r in found.withColumn("r", rank).filter(F.col("r") <= k).collect():  # k rows for each probe
        out[r["q"]].append(np.array(r["v"]))
    return out


def visits_needed(tree: Tree, probes: np.ndarray, nearest: list[list[np.ndarray]], recall: float) -> int:
    """Leaves to visit for the mean recall wanted."""
    places: list[int] = []
    for q, found in zip(_unit(probes), nearest, strict=True):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.walk(q))}
        places += [place[x] for x in tree.assign(_unit(np.array(found))).tolist()] if found else []
    if not places:
        return tree.leaves
    return int(np.sort(places)[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)])


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by every."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("v") == lengths["n"])
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("r", order).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = kept(distinct.select("v", "ids"), "vectors")
    n = distinct.count()
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.select("v").filter(draw < min(1.0, SAMPLE / n)).toArrow()
    base = _unit(_matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.array([distinct.first()["v"]]))
    tree = grow(base[np.lexsort(base.T[:4])], max(LEAF, int(len(base) / (LEAVES * n**0.5))))
    probes = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v", F.lit(1)), "v").limit(CALIBRATION).collect()])
    visits = visits_needed(tree, probes, [found[1:] for found in _brute_force(distinct, probes, k + 1)], recall)  # without the probe itself
    sent = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def to_leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = sent.value.assign(_unit(_matrix(b.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", *b.schema.names])

    def to_visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [list(islice(sent.value.walk(q), visits)) for q in _unit(_matrix(b.column(0)))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int64()))], names=[*b.schema.names, "leaves"])

    held = kept(distinct.mapInArrow(to_leaf, "leaf long, v array<double>, ids array<long>"), "leaves")
    asked = rows.filter(F.col("id") % every == 0)
    queries = kept(asked.groupBy("v").agg(F.min("id").alias("qkey")).mapInArrow(to_visits, "v array<double>, qkey long, leaves array<long>"), "queries")
    visiting = queries.select("v", "qkey", F.explode("leaves").alias("leaf"))
    # As many rows as the tree has leaves, which the sample bounds.
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    cells = F.broadcast(kept(blocks(held, "of_held").join(blocks(visiting, "of_visits"), "leaf"), "cells"))
    mine = lambda key, n: F.pmod(F.xxhash64(key, F.lit(2)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = held.join(cells, "leaf").select("leaf", mine("v", "of_held").alias("block"), each("of_visits").alias("visit"), "v", "ids")
    visiting = visiting.join(cells, "leaf").select("leaf", each("of_held").alias("block"), mine("qkey", "of_visits").alias("visit"), "v", "qkey")

    def meet(key: tuple, candidates: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("qkey", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])
        if not candidates.num_rows or not asking.num_rows:
            return schema.empty_table()
        c, q = (_matrix(t.column("v").combine_chunks()) for t in (candidates, asking))
        ids, qkeys = candidates.column("ids").to_pylist(), asking.column("qkey").to_pylist()
        found: list[list[tuple[float, int]]] = [[] for _ in qkeys]
        for i, j, s in _nearest(q, c, np.array([x[0] for x in ids]), k + 1):
            found[i] += [(-s, x) for x in ids[j]]
        rows = [(q, -s, x) for q, f in zip(qkeys, found, strict=True) for s, x in sorted(f)[: k + 1]]
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    by_cell = ("leaf", "block", "visit")
    met = held.groupBy(*by_cell).cogroup(visiting.groupBy(*by_cell)).applyInArrow(meet, "qkey long, score double, vec_id long")
    place = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))
    best = met.withColumn("place", place).filter(F.col("place") <= k + 1)
    best = best.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # k + 1 of each query
    named = asked.join(queries.select(F.col("v").alias("qv"), "qkey"), F.col("v") == F.col("qv")).select(F.col("id").alias("query_id"), "qkey")
    out = named.join(best, "qkey").select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_ann_search": op8_ann_search}
