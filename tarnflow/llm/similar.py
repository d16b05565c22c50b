"""SimHash near-duplicates of a given similarity: the generalised pigeonhole search for candidates, then the Jaccard similarity itself.

Texts of similarity 0.8 differ in about ten bits of 64, with a deviation of 3, and 64 bits don't tell them from texts that
share a passage. So the fingerprints have 192 bits here (29 expected, a deviation of 5), of the set of shingles, as is the
similarity. Texts with the same set collapse to one node. As in simhash, correlated bits are grouped into partitions, dynamic
programming picks thresholds with sum(t_i + 1) = DISTANCE + 1 of least cost, a node probes its own value of each
partition and those within t_i of it, and what it meets there is verified on all bits. All pairs within DISTANCE bits meet; of
those beyond nearly all do, as one partition is enough, and they are taken up to WIDE bits (small sets are granted more).

Probes at that distance are some 200 a node, so they are not dealt as rows. Nodes are cut into blocks by the size of their
sets; two blocks meet in a task of its own if their sizes allow the similarity, and probe each other in memory. Each
cell gives a forest instead of pairs. The components of these forests are only the groups within which the sets themselves
are compared, all with all, in tiles of bounded size. Links are pairs whose similarity, counted exactly, reaches the bound.

Null and empty texts are one node without links to others, texts of fewer words than a shingle have one shingle. Repeated
rows share a node. A null doc_id stands for a component only if all its doc_ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, sieve, sieved, tidy
from .components import components
from .simhash import Forest, _ball, _flips, allocate, correlated_groups, fingerprint_of, join_pairs, shingle_hashes, without_copies

WORDS, DISTANCE, WIDE, WIDE_SMALL, SMALL = 3, 41, 56, 68, 20
#: Nodes of a block, and sets of a group, that one task compares with others at once.
TILE, SETS = 65_536, 512
#: Small tables are cut into about BLOCKS blocks, of at least LEAST nodes.
BLOCKS, LEAST = 12, 8192
#: Fingerprints that the plan is made from, which changes its cost and no result; numbers of partitions it chooses from; the cost
#: of a bucket and of a probed one, in comparisons.
SAMPLE, PARTITIONS, BUCKET_COST, PROBE_COST, MOST_PROBES = 1024, (12, 14, 16, 18, 21, 28, 42), 10_000.0, 75.0, 800
_COLUMNS, PAIRS = 2048, 250_000
#: Texts whose copies a task knows.
SEEN = 50_000
FP = [f"fp{k}" for k in range(WORDS)]


def shingle_set(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The node of a text, which is a hash of its set, and the set in ascending order."""
    from xxhash import xxh64_intdigest

    some = np.unique(hashes)
    return int(np.uint64(xxh64_intdigest(some.tobytes(), len(some))).view(np.int64)), some


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WORDS fingerprints side by side, the first that of the hashes and the others of hashes mixed from them."""
    out = []
    for k in range(WORDS):
        h = hashes.astype(np.uint64)
        if k:
            h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        out.append(fingerprint_of(h))
    return np.array(out, dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, node, size and the words of the fingerprint of the set of each of docs (doc_id, text)."""
    arrow_rows(docs.sparkSession)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for t in batch.column(1):
                node, some = shingle_set(shingle_hashes(t.as_py(), shingle))
                made.append((node, len(some), *np.frombuffer(wide_fingerprint(some), dtype=np.int64).tolist()))
            arrays = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * (2 + WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "text_key", "node", "size", *FP])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(tidy(each), f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, node long, size long, " + ", ".join(f"{x} long" for x in FP))


# The plan: partitions and thresholds, and blocks


def _keys(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of the fingerprints (a row of WORDS unsigned words each) side by side."""
    out = np.zeros(len(fp), dtype=np.uint32)
    for i, b in enumerate(bits):
        out |= ((fp[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.uint32) << np.uint32(i)
    return out


def plan(sample: np.ndarray, nodes: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is used, for blocks of so many nodes with fingerprints like the sample's."""
    n = len(sample)
    ones = np.ones((n, 64 * WORDS + 1))
    ones[:, :-1] = np.unpackbits(sample.view(np.uint8).reshape(n, 8 * WORDS), axis=1, bitorder="little")
    counts = ones.T @ ones
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in PARTITIONS:
        groups, costs = correlated_groups(counts, m), []
        for bits in groups:
            keys = _keys(sample, bits)
            apart = np.bincount(np.bitwise_count(keys[:, None] ^ keys[None, :]).ravel(), minlength=len(bits) + 1).astype(float)
            apart[0] -= n  # a node with itself
            share, buckets, row = np.cumsum(apart) / max(1, n * (n - 1)), min(1.0, 2.0 ** len(bits) / max(1, nodes)), [0.0]
            for t in range(min(len(bits), distance) + 1):
                if (probes := _ball(len(bits), t)) > MOST_PROBES:
                    break
                row.append(buckets * (BUCKET_COST + PROBE_COST * probes) + float(share[t]) * nodes)
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        if cost < best[0]:
            best = cost, [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def blocks(bins: list[tuple[int, int, int, int]], most: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """bins of sizes (bin, nodes, least and greatest size) in ascending order, cut into blocks of at most about `most` nodes. For each bin: bin, its
    block, how many from there share it (by hash), and the first and last of the blocks whose sizes allow the similarity."""
    spans, found, held = [], [], 0
    for name, n, lo, hi in bins:
        parts = max(1, -(-n // most))
        if parts > 1 or not found or held + n > most:
            spans.append((name, len(found), parts))
            found += [(lo, hi)] * parts
            held = most if parts > 1 else n
        else:
            spans.append((name, len(found) - 1, 1))
            found[-1] = found[-1][0], hi
            held += n
    lows, highs = np.array([x for x, _ in found]), np.array([x for _, x in found])
    first = np.searchsorted(highs, similarity * lows - 1e-9, side="left")
    last = np.searchsorted(similarity * lows - 1e-9, highs, side="right") - 1
    return [(name, at, parts, int(first[at]), int(last[at])) for name, at, parts in spans]


def _cells(rows: DataFrame, tile: int, by: str, of: str) -> DataFrame:
    """Rows with n, the size of what `by` names, dealt to cells: key, first (of the pair of tiles), own (a tile with itself)."""
    rows = rows.withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(of), F.col("tiles")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("i"), F.greatest(o, F.col("tile")).alias("j")))
    rows = rows.withColumn("cell", F.explode(cells))
    return rows.withColumns({"key": F.xxhash64(by, "cell"), "first": F.col("tile") == F.col("cell.i"), "own": F.col("cell.i") == F.col("cell.j")})


def _forest(dealt: DataFrame, compare: Callable[[pa.RecordBatch, Forest], None], tasks: int = 0) -> DataFrame:
    """a, b: the forest of what compare joins among the rows of each key, the first column; tasks: how many to deal the keys to, if not Spark's own number."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.concat_batches([*held, batch]) if held else batch
            if not rows.num_rows:
                continue
            bounds = [0, *(np.flatnonzero(np.diff(rows.column(0).to_numpy())) + 1).tolist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    compare(rows.slice(a, b - a), forest)
            held = [rows.slice(bounds[-1])]
        if held and held[0].num_rows > 1:
            compare(held[0], forest)
        pairs = [(x, r) for x in list(forest.up) if (r := forest.find(x)) != x]
        for at in range(0, len(pairs), 50_000):
            a, b = zip(*pairs[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = dealt.repartition(tasks, "key") if tasks else dealt.repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(tidy(each), "a long, b long")


def meet(fp: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, similarity: float) -> None:
    """Compares the nodes of left and right, which are indices, and gives those that may be similar, with all of their trees, one label."""
    work, looked = [(left, right)], False
    while work:
        left, right = work.pop()
        if not len(left) or not len(right):
            continue
        if not looked and len(left) * len(right) > PAIRS:
            # Nodes of the largest tree need no comparison with each other.
            names, n = np.unique(label[right], return_counts=True)
            tree, looked = names[np.argmax(n)], True
            same = label[left] == tree
            if n.max() > 1 and same.any():
                work += [(left[~same], right), (left[same], right[label[right] != tree])]
                continue
        step = max(1, PAIRS // len(right))
        rows, left = left[:step], left[step:]
        work.append((left, right))
        apart = np.zeros((len(rows), len(right)), dtype=np.uint8)
        for k in range(WORDS):
            apart += np.bitwise_count(fp[rows, k][:, None] ^ fp[right, k][None, :])
        i, j = np.nonzero(apart <= WIDE_SMALL)
        a, b = rows[i], right[j]
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        may = (apart[i, j] <= np.where(low < SMALL, WIDE_SMALL, WIDE)) & (low >= similarity * high - 1e-9) & (label[a] != label[b])
        if not may.any():
            continue
        a, b, looked = a[may], b[may], False  # in the order of a
        cuts = np.flatnonzero(np.diff(a)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
            old = np.unique(np.append(label[b[at:to]], label[a[at]]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]


def search(fp: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, partitions: list[tuple[list[int], int]], similarity: float) -> np.ndarray:
    """A label for each node, the same for all of a tree: left and right (indices, equal for a block with itself) probe each other's values in each partition."""
    label, own = np.arange(len(fp)), left is right
    for bits, t in partitions:
        key, flips = _keys(fp, bits).astype(np.int64), np.array([0, *_flips(len(bits), t)], dtype=np.int64)
        l, r = (some[np.argsort(key[some], kind="stable")] for some in (left, right))
        buckets, at = np.unique(key[l], return_index=True)
        for k, some in zip(buckets.tolist(), np.split(l, at[1:]), strict=True):
            values = k ^ flips
            values = values[values >= k] if own else values
            a, b = np.searchsorted(key[r], values, "left"), np.searchsorted(key[r], values, "right")
            met = [r[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if y > x]
            if met:
                meet(fp, size, some, np.concatenate(met), label, similarity)
    return label


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: a forest that joins all nodes (node, size and the words of the fingerprint) that may be similar."""
    spark = nodes.sparkSession
    nodes = nodes.filter("size > 0")
    size = F.col("size")
    # Sizes up to 1024, then 64 to each doubling: some 3,000 at most.
    nodes = nodes.withColumn("bin", F.when(size < 1024, size).otherwise(1024 + F.floor(64 * F.log2(size / 1024))))
    bins = [tuple(r) for r in nodes.groupBy("bin").agg(F.count(F.lit(1)), F.min("size"), F.max("size")).orderBy("bin").collect()]
    total = sum(r[1] for r in bins)
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    most = min(TILE, max(LEAST, -(-total // BLOCKS)))
    dealt = blocks(bins, most, similarity)
    drawn = nodes.select(*FP).filter(F.pmod(F.xxhash64("node"), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).toArrow()
    partitions = plan(np.column_stack([drawn.column(x).to_numpy() for x in FP]).view(np.uint64), min(most, total), DISTANCE)
    n = max(at + parts for _, at, parts, _, _ in dealt)
    cells = {(i, j) for _, at, parts, a, b in dealt for i in range(at, at + parts) for j in range(i, b + 1)}

    def compare(batch: pa.RecordBatch, forest: Forest) -> None:
        node, size, *fp = (batch.column(i).to_numpy() for i in range(1, 3 + WORDS))
        first, own = batch.column(3 + WORDS).to_numpy(zero_copy_only=False), batch.column(4 + WORDS)[0].as_py()
        left = np.arange(len(node)) if own else np.flatnonzero(first)
        right = left if own else np.flatnonzero(~first)
        label = search(np.column_stack(fp).view(np.uint64), size, left, right, partitions, similarity)
        some = np.flatnonzero(label != np.arange(len(label)))
        for a, b in zip(node[some].tolist(), node[label[some]].tolist(), strict=True):
            forest.join(a, b)

    rows = nodes.join(F.broadcast(spark.createDataFrame(dealt, "bin long, at int, parts int, low int, high int")), "bin")
    rows = rows.withColumn("block", F.col("at") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence("low", "high")))
    key = (F.least("block", "other").cast("long") * n + F.greatest("block", "other")).alias("key")
    rows = rows.select(key, "node", "size", *FP, (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("own"))
    # Batches are of rows of numbers here.
    arrow_rows(spark, 10_000)
    return _forest(rows, compare, min(1000, 2 * len(cells)))


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of left and each of right have in common; the elements of a set differ."""
    both = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    values, name, n = np.unique(both, return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    keep = n[name] > 1
    owner, column = owner[keep], rank[name[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        has = np.zeros((len(left) + len(right), int(column[b - 1]) + 1 - at), dtype=np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: a forest of the pairs of nodes within the groups (node, root) whose sets are similar."""
    arrow_rows(docs.sparkSession, 128)
    sizes = kept(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = kept(groups.join(sizes, "root").join(nodes.select("node", "text_key"), "node").select("text_key", F.col("node").alias("of"), "root", "n"), "wanted")
    words = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.col("text_key").alias("key")).distinct()))  # of bounded size

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that may be wanted; most copies of a text go at once, so that none is moved a million times."""
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(1).to_numpy()
            held = sieved(words.value, keys)
            for i in np.flatnonzero(held).tolist():
                if int(keys[i]) in seen:
                    held[i] = False
                elif len(seen) < SEEN:
                    seen.add(int(keys[i]))
            yield batch.filter(pa.array(held))

    texts = docs.select("text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(passed), "text string, text_key long")
    texts = texts.join(wanted, "text_key").select("text", "of", "root", "n")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(shingle_hashes(t.as_py(), shingle)) for t in batch.column(0)]
            right = pa.array([node == of for (node, _), of in zip(found, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            made = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s.tobytes() for _, s in found], pa.binary())], names=["node", "root", "n", "elements"])
            yield made.filter(right)

    rows = texts.mapInArrow(tidy(sets), "node long, root long, n long, elements binary").dropDuplicates(["node"])

    def compare(batch: pa.RecordBatch, forest: Forest) -> None:
        node, elements = batch.column(1).to_numpy(), [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(2)]
        first, own = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)[0].as_py()
        left, right = (np.arange(len(node)),) * 2 if own else (np.flatnonzero(first), np.flatnonzero(~first))
        if not len(left) or not len(right):
            return
        size = np.array([len(s) for s in elements], dtype=np.float64)
        both = shared([elements[i] for i in left], [elements[i] for i in right])
        alike = (both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-9) & (node[left][:, None] != node[right][None, :])
        join_pairs(*np.nonzero(alike), node[left], node[right], forest)

    return _forest(_cells(rows, SETS, "root", "node").select("key", "node", "elements", "first", "own"), compare)


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, text_key (XXH64 of the text), root (of the component), component_id (its least doc_id) of each of docs (doc_id, text)."""
    spark = docs.sparkSession
    each = kept(sketches(docs, shingle), "sketches")
    nodes = kept(each.groupBy("node").agg(*[F.min(x).alias(to) for x, to in [("doc_id", "least"), *((x, x) for x in ("text_key", "size", *FP))]]), "nodes")
    groups = kept(components(candidates(nodes, similarity)), "groups")
    found = components(verified(docs, nodes, groups, shingle, similarity)).withColumnRenamed("node", "member")
    arrow_rows(spark)
    rooted = nodes.join(found, nodes["node"] == found["member"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = kept(rooted, "rooted")
    least = kept(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = kept(rooted.join(least, "root").select(F.col("node").alias("member"), "root", "component_id"), "components")
    return each.join(named, each["node"] == named["member"]).select("doc_id", "text_key", "root", "component_id")


def keep(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs with one document of each component, that with the least doc_id, and one row of it. Rows without a doc_id stay."""
    return without_copies(docs, similar(docs, similarity, shingle))
