"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: bit i of a text's 64-bit fingerprint is the majority of bit i over the XXH64 of its word shingles.
Texts with equal fingerprints collapse to one row before any search. Correlated bits are grouped into partitions, so
that some are selective and others are not. If two fingerprints differ in at most k bits, then for any thresholds t_i
with sum(t_i + 1) = k + 1 some partition i differs in at most t_i; dynamic programming picks the thresholds (-1: don't
use the partition) of least cost, from the pairs that equal values make in each partition, counted over all
fingerprints, and from the rows that probing takes. A fingerprint probes its own value and those within t_i of it; each
bucket compares what it holds with numpy, verifies the distance and gives a spanning forest of its links rather than
all pairs. Buckets of over TILE rows are cut into tiles, each pair of which meets in a task of its own: exact at any
size, and no task holds more than two tiles. The forest's components come from alternating stars.

Null and empty texts have no words and fingerprint zero, linked like any other. Repeated rows share a fingerprint. A
null doc_id takes part, but stands for a component only if all its doc_ids are null. An empty table gives no rows.
Texts of any length are hashed whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, free_name, kept, sieve, sieved, table
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Rows of a bucket that one task compares with each other at once.
TILE = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, in the order of the text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    ends = (starts[min(shingle, len(words)) :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)), dtype="<u8", count=n)


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each of docs (doc_id, text); keyed: text_key too, the text's XXH64."""
    arrow_rows(docs.sparkSession)
    names = ["doc_id", "fp", *(["text_key"] if keyed else [])]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)

    rows = docs.select("doc_id", "text", *([F.xxhash64("text").alias("text_key")] if keyed else []))
    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long" + (", text_key long" if keyed else ""))


# The plan: partitions and thresholds


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """65 x 65 counts over all fingerprints of bits that are set together; the last row and column count single bits and rows. Each task sends one matrix."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            bits = np.ones((batch.num_rows, BITS + 1), dtype=np.float64)
            bits[:, :BITS] = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * (BITS + 1) + j, pa.int64()), pa.array(total[i, j])], names=["cell", "n"])

    out = np.zeros((BITS + 1) ** 2)
    for r in distinct.select("fp").mapInArrow(each, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(BITS + 1, BITS + 1)


def correlated_groups(counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of like size: a group starts with the strongest pair left and takes the bit that correlates most with it."""
    n = max(1.0, counts[-1, -1])
    mean = counts[-1, :-1] / n
    cov = counts[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(len(corr))), []
    for p in range(parts):
        size = (len(corr) - sum(map(len, out))) // (parts - p)
        rest = sorted(left)
        sub = corr[np.ix_(rest, rest)]
        group = [rest[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < size:
            rest = [b for b in sorted(left) if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        left -= set(group)
        out.append(sorted(group))
    return out


def _ball(width: int, t: int) -> int:
    total, term = 0, 1
    for i in range(t + 1):
        total += term
        term = term * (width - i) // (i + 1)
    return total


#: Cost of a probing row and of a comparison, relative to each other: a row is written, shuffled, sorted and read.
ROW_COST, PAIR_COST, MOST_PROBES = 400.0, 1.0, 800


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """costs[i][t + 1] of threshold t in partition i; the thresholds with sum(t + 1) = budget of least cost."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * budget
    for row in costs:
        best = [min(((best[b - u][0] + row[u], [*best[b - u][1], u - 1]) for u in range(min(b, len(row) - 1) + 1)), key=lambda x: x[0]) for b in range(budget + 1)]
    return best[budget]


def _key(bits: list[int]):
    """The bits of fp side by side, for Spark."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def plan(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is used."""
    counts = bit_counts(distinct)
    n = counts[-1, -1]
    options = {m: correlated_groups(counts, m) for m in range(2, distance + 2)}
    listed = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _key(bits).alias("v")) for k, (_, _, bits) in enumerate(listed)])).alias("x")
    same = {r["k"]: r["pairs"] for r in distinct.select(values).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}
    mean = counts[-1, :-1] / max(1.0, n)
    differ = np.clip(2 * mean * (1 - mean), 1e-6, 0.5)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            # Pairs at partition distance d: those at 0 are counted, further ones follow from each bit's own odds of differing.
            odds, row, pairs = differ[bits] / (1 - differ[bits]), [0.0], 0.0
            level = np.zeros(distance + 1)
            level[0] = same.get(listed.index((m, i, bits)), 0.0)
            for o in odds:
                level[1:] += level[:-1] * o
            for t in range(distance + 1):
                pairs += level[t]
                probes = _ball(len(bits), t)
                row.append(float("inf") if probes > MOST_PROBES else ROW_COST * n * probes + PAIR_COST * min(pairs, n * n))
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        if cost < best[0]:
            best = cost, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


# Probing and verification


def _flips(width: int, t: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in some) for r in range(1, t + 1) for some in combinations(range(width), r)]


def _probe(part: int, bits: list[int]):
    return lambda flip: F.struct(F.lit(part).alias("part"), _key(bits).bitwiseXOR(flip).alias("v"), F.lit(1).alias("probe"))


class Forest:
    """Union by the least node, to drop links that join nothing new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while (parent := up.get(x, x)) != root:
            up[x], x = root, parent
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def join_pairs(i: np.ndarray, j: np.ndarray, names_l: np.ndarray, names_r: np.ndarray, forest: Forest) -> None:
    """Joins names_l[i] and names_r[j]. Of the pairs only those go to the forest that join a row's or column's first partner,
    then those that are still apart, so that a dense group costs no Python step for each pair."""
    while len(i):
        _, first_i = np.unique(i, return_index=True)
        _, first_j = np.unique(j, return_index=True)
        some = np.union1d(first_i, first_j) if len(i) > 64 else np.arange(len(i))
        for a, b in zip(names_l[i[some]].tolist(), names_r[j[some]].tolist(), strict=True):
            forest.join(a, b)
        if len(some) == len(i):
            break
        (rows, back_i), (columns, back_j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        root_i = np.array([forest.find(x) for x in names_l[rows].tolist()])
        root_j = np.array([forest.find(x) for x in names_r[columns].tolist()])
        apart = root_i[back_i] != root_j[back_j]
        i, j = i[apart], j[apart]


def near(left: np.ndarray, right: np.ndarray, distance: int, forest: Forest) -> None:
    """Joins all of left and right that differ in 1 to distance bits."""
    step = max(1, 500_000 // max(1, len(right)))
    names_l, names_r = left.view(np.int64), right.view(np.int64)
    for at in range(0, len(left), step):
        d = np.bitwise_count(left[at : at + step, None] ^ right[None, :])
        i, j = np.nonzero((d - np.uint8(1)) < distance)
        join_pairs(i, j, names_l[at : at + step], names_r, forest)


def links(distinct: DataFrame, partitions: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """a, b: a forest of links that joins all fingerprints within the distance of each other."""
    own = F.array(*[F.struct(F.lit(k).alias("part"), _key(bits).alias("v"), F.lit(0).alias("probe")) for k, (bits, _) in enumerate(partitions)])
    sets = [own]
    for k, (bits, t) in enumerate(partitions):
        if t > 0:
            flips = F.array(*[F.lit(x).cast("long") for x in _flips(len(bits), t)])
            sets.append(F.transform(flips, _probe(k, bits)))
    rows = distinct.select("fp", F.explode(F.concat(*sets) if len(sets) > 1 else own).alias("x")).select("fp", "x.*")
    # Buckets with one row and no partner need no comparison; large ones are cut into tiles.
    sizes = rows.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    sizes = kept(sizes, "buckets")
    rows = rows.join(sizes, ["part", "v"], "left") if sizes.take(1) else rows.withColumn("n", F.lit(None).cast("long"))
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # Tile i meets tile j, i <= j, in cell (i, j).
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("i"), F.greatest(o, F.col("tile")).alias("j")))
    rows = rows.withColumn("cell", F.explode(cells)).select(F.xxhash64("part", "v", "cell").alias("key"), "fp", "probe", (F.col("tile") == F.col("cell.i")).alias("first"), (F.col("cell.i") == F.col("cell.j")).alias("own"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def compare(fp: np.ndarray, probe: np.ndarray, first: np.ndarray, own: bool) -> None:
            if len(fp) < 2:
                return
            exact = probe == 0
            if own:
                near(fp[exact], fp, distance, forest)
            else:
                near(fp[exact & first], fp[~first], distance, forest)
                near(fp[~exact & first], fp[exact & ~first], distance, forest)

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            columns[1] = columns[1].astype(np.int64).view(np.uint64)
            if held:
                columns = [np.concatenate(x) for x in zip(*held, columns, strict=True)]
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            bounds = [0, *cuts.tolist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    compare(columns[1][a:b], columns[2][a:b], columns[3][a:b], bool(columns[4][a]))
            held = [tuple(c[bounds[-1] :] for c in columns)]
        if held:
            compare(held[0][1], held[0][2], held[0][3], bool(held[0][4][0]))
        pairs = [(x, forest.find(x)) for x in list(forest.up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        for at in range(0, len(pairs), 50_000):
            a, b = zip(*pairs[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of all that links reach) of each of docs (doc_id, text); keyed: text_key and
    root too, which names the component where repeated doc_ids give two of them the same component_id."""
    spark = docs.sparkSession
    each = kept(fingerprints(docs, shingle, keyed), "fingerprints")
    distinct = kept(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    arrow_rows(spark, 10_000)
    partitions = plan(distinct, distance)
    found = components(links(distinct, partitions, distance)) if partitions else spark.createDataFrame([], "node long, root long")
    arrow_rows(spark)
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first: a join of two plain exchanges can be split by AQE where a root has many fingerprints.
    least = kept(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    more = ["root"] if keyed else []
    named = kept(rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id", *more), "components")
    return each.join(named, each["fp"] == named["fp_"]).select("doc_id", "fp", "component_id", *(["text_key", "root"] if keyed else []))


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs with one document of each component of found (doc_id, text_key, root, component_id), that with the least
    doc_id, and one row of it. The others are few beside the texts, so it is these that the texts are held against, by doc_id
    and text: a doc_id may have texts of several components, each of which is judged for itself. Only the texts of doc_ids that
    occur several times in a component are held against each other. Rows without a doc_id stay."""
    gone_id, gone_key, root, mark = (free_name(docs, x) for x in ("gone_id", "gone_key", "root", "mark"))
    gone = kept(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "gone")
    names = docs.columns
    words = docs.sparkSession.sparkContext.broadcast(sieve(gone.select(F.xxhash64(gone_id, gone_key).alias("key"))))  # of bounded size

    def passed(may: bool):
        """The rows that the sieve holds, or those that it doesn't: these stay for certain, and are never moved."""

        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = sieved(words.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(held == may))

        return docs.withColumn(mark, F.xxhash64("doc_id", F.xxhash64("text"))).mapInArrow(each, docs.schema)

    arrow_rows(docs.sparkSession)
    maybe = passed(True)
    stay = passed(False).unionByName(maybe.join(gone, (maybe["doc_id"] == gone[gone_id]) & (F.xxhash64(maybe["text"]) == gone[gone_key]), "left_anti")).select(*names)
    again = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = kept(again.select(F.col("doc_id").alias(gone_id)).distinct(), "again")
    if not again.take(1):
        return stay
    parts = found.join(again, found["doc_id"] == again[gone_id], "left_semi")
    parts = kept(parts.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("root").alias(root)).distinct(), "parts")
    once = stay.join(again, stay["doc_id"] == again[gone_id], "left_anti")
    several = stay.join(parts, (stay["doc_id"] == parts[gone_id]) & (F.xxhash64(stay["text"]) == parts[gone_key]))
    return once.unionByName(several.dropDuplicates(["doc_id", root]).select(*docs.columns))


def keep(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    return without_copies(docs, near_duplicates(docs, distance, shingle, keyed=True))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
