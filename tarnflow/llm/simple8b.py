"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of values, the first value lowest. A value of more
than 60 bits has a word of its own with selector 15, whose low bits are its place in a list of escapes. Values are
coded in blocks of BLOCK; no word crosses a block, so each block can be decoded by its word offset alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
# Fixed values of the format: how many values a word of selector 0, 1, ... 14 holds, and of how many bits; 15 is an escape.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], dtype=np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], dtype=np.int64)
ESCAPE = 15
_MOST = int(COUNTS.max())


def _classes(values: np.ndarray) -> np.ndarray:
    """The first selector that is wide enough for each value."""
    limits = np.array([1 << int(w) for w in WIDTHS[:ESCAPE]], dtype=np.uint64)
    return np.searchsorted(limits, values, side="right").astype(np.uint8)


def _selectors(classes: np.ndarray) -> np.ndarray:
    """For each place of each padded block, the selector that packs most values from there on."""
    n = classes.shape[1] - _MOST
    runs, width = {1: classes}, 1
    while width * 2 <= _MOST:
        last = runs[width]
        runs[width * 2] = np.maximum(last[:, : last.shape[1] - width], last[:, width:])
        width *= 2
    out = np.full((classes.shape[0], n), ESCAPE, dtype=np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        count = int(COUNTS[s])
        half = 1 << (count.bit_length() - 1)
        top = np.maximum(runs[half][:, :n], runs[half][:, count - half : count - half + n])
        np.copyto(out, np.uint8(s), where=top <= s)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, the word offset of each block and one more, escapes."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n_blocks = -(-len(values) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((n_blocks, BLOCK + _MOST), dtype=np.uint64)
    full = np.zeros(n_blocks * BLOCK, dtype=np.uint64)
    full[: len(values)] = values
    grid[:, :BLOCK] = full.reshape(n_blocks, BLOCK)
    best = _selectors(_classes(grid.ravel()).reshape(grid.shape))
    lengths = np.full(n_blocks, BLOCK, dtype=np.int64)
    lengths[-1] = len(values) - (n_blocks - 1) * BLOCK
    at, rows, block, place, chosen = np.zeros(n_blocks, np.int64), np.arange(n_blocks), [], [], []
    while len(rows):
        s = best[rows, at[rows]]
        block.append(rows)
        place.append(at[rows])
        chosen.append(s)
        at[rows] += COUNTS[s]
        rows = rows[at[rows] < lengths[rows]]
    block, place, chosen = map(np.concatenate, (block, place, chosen))
    order = np.lexsort((place, block))
    block, place, chosen = block[order], place[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    flat, base = grid.ravel(), block * grid.shape[1] + place
    for s in range(1, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            escapes = flat[base[mine]]
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        acc = np.zeros(len(mine), dtype=np.uint64)
        for j in range(int(COUNTS[s])):
            acc |= flat[base[mine] + j] << np.uint64(int(WIDTHS[s]) * j)
        words[mine] |= acc
    offsets = np.zeros(n_blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(block, minlength=n_blocks))
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks."""
    n_blocks = len(offsets) - 1
    if not n_blocks or not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    starts = ends - counts
    block = np.repeat(np.arange(n_blocks), np.diff(offsets.astype(np.int64)))
    wide = BLOCK + _MOST
    base = starts - starts[offsets[:-1].astype(np.int64)][block] + block * wide
    out = np.zeros(n_blocks * wide, dtype=np.uint64)
    low = words & np.uint64((1 << 60) - 1)
    for s in range(1, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            out[base[mine]] = escapes[low[mine].astype(np.int64)]
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for j in range(int(COUNTS[s])):
            out[base[mine] + j] = (low[mine] >> np.uint64(width * j)) & mask
    return out.reshape(n_blocks, wide)[:, :BLOCK].reshape(-1)[:n]
