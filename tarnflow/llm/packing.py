"""Packing of token sequences by non-negative least squares over shallow length combinations.

A task packs its documents in blocks. Whole windows are cut off long documents first. The rest of each document falls
into a bin by its length; combinations of at most DEPTH bins whose upper edges fill a window are enumerated once, and
non-negative least squares finds how often to repeat each so that together they use up the block's histogram. The
repeats are rounded down and served with documents; what a combination leaves free, at most a bin's width for each
document, is filled greedily with slices of the documents left over, and these fill further windows in turn. So all
sequences are full, but the last of a block, which is cut into sequences of powers of two, as those need no padding. No rows move between tasks.

Null and empty texts are packed as the end id alone. Null doc_ids and repeated rows are packed like any others; an
empty table gives no rows; other columns are not read. A very long text becomes as many windows as it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, table, tidy
from .tokens import default_vocabulary, text_ids

WINDOW, BINS, DEPTH = 4096, 32, 4
#: Ids of documents' rests in a block.
BLOCK_IDS = 8_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """bins x combinations: how many documents of each bin a combination takes. Bin b holds lengths up to (b + 1) / bins of a window."""
    found: list[list[int]] = []

    def extend(used: list[int], room: int, most: int) -> None:
        if used and (room == 0 or len(used) == depth and room <= 2):
            found.append(used)
            return
        if len(used) < depth:
            for size in range(min(room, most), 0, -1):
                extend([*used, size], room - size, size)

    extend([], bins, bins)
    out = np.zeros((bins, len(found)))
    for k, sizes in enumerate(found):
        for s in sizes:
            out[s - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set: the column that helps most enters, those that turn negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= tolerance:
            break
        active[k] = True
        while True:
            columns = np.flatnonzero(active)
            z = np.zeros_like(x)
            z[columns] = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            low = columns[z[columns] <= 1e-12]
            if not len(low):
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.maximum(x + step * (z - x), 0)
            active &= x > 1e-12
            x[~active] = 0
    return x


def pack_block(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents shorter than a window; each id lies in one piece."""
    bins = np.minimum((lengths - 1) * BINS // window, BINS - 1)
    pools: list[list[int]] = [[] for _ in range(BINS)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        pools[bins[d]].append(d)
    table = combinations()
    repeats = np.floor(nnls(table, np.bincount(bins, minlength=BINS).astype(float)) + 1e-9).astype(int)
    sequences: list[list[tuple[int, int, int]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        wants = [(b, int(n)) for b, n in enumerate(table[:, k]) if n]
        for _ in range(int(repeats[k])):
            if any(len(pools[b]) < n for b, n in wants):
                break
            picked = [pools[b].pop() for b, n in wants for _ in range(n)]
            sequences.append([(d, 0, int(lengths[d])) for d in picked])
    rest = [(d, 0, int(lengths[d])) for d in sorted((d for p in pools for d in p), key=lambda d: -lengths[d])]
    return fill(sequences, rest, window)


def fill(sequences: list[list[tuple[int, int, int]]], rest: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Fills what the sequences leave free with slices of the rest, then the rest goes in windows of its own. Sequences come apart, from the last, where the rest runs out."""
    done, rest = [], rest[::-1]
    while sequences or rest:
        now = sequences.pop() if sequences else []
        room = window - sum(p[2] for p in now)
        while room:
            if not rest:
                if not sequences:
                    break
                rest = sequences.pop(0)[::-1]
            d, start, n = rest.pop()
            if n > room:
                rest.append((d, start + room, n - room))
                n = room
            now.append((d, start, n))
            room -= n
        done.append(now)
    if done and sum(p[2] for p in done[-1]) < window:
        done.extend(by_powers(done.pop()))
    return done


def by_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The one sequence of a block that isn't full, as sequences of powers of two, which need no padding."""
    total, out, left = sum(p[2] for p in pieces), [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        room, now = total & (1 << bit), []
        while room:
            d, start, n = left.pop()
            if n > room:
                left.append((d, start + room, n - room))
                n = room
            now.append((d, start, n))
            room -= n
        if now:
            out.append(now)
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """A row for each piece of docs (doc_id, text)."""
    vocabulary, end = vocabulary or default_vocabulary(), struct.pack("<I", end_id)
    arrow_rows(docs.sparkSession)
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = text_ids(vocabulary).encode, TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids before, ids of the document, its rest
        held = 0

        def flush() -> None:
            nonlocal sequence, waiting, held
            if waiting:
                lengths = np.array([len(w[3]) // 4 for w in waiting], dtype=np.int64)
                for pieces in pack_block(lengths, window):
                    offset = 0
                    for d, start, n in pieces:
                        doc_id, before, total, ids = waiting[d]
                        rows.append((doc_id, before + start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), total, sequence, offset))
                        offset += n
                    sequence += 1
            waiting, held = [], 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    rows.append((doc_id, start, window, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + window)]), total, sequence, 0))
                    sequence += 1
                if total > whole:
                    waiting.append((doc_id, whole, total, ids[4 * whole :]))
                    held += total - whole
                    if held >= BLOCK_IDS:
                        flush()
            if len(rows) >= 10_000:
                yield out()
        flush()
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(tidy(each), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
