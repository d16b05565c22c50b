"""Kafka's default partition of a key: murmur2 of its bytes, made positive, modulo the partitions.

Only needed to name the very partition a Kafka producer would pick; Spark's own exchanges place keys otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of murmur2 as Kafka uses it.
_SEED, _M, _R = 0x9747B28C, 0x5BD1E995, 24
_LOW = 0xFFFFFFFF


def murmur2(key: bytes) -> int:
    h = _SEED ^ len(key)
    whole = len(key) // 4 * 4
    for k in np.frombuffer(key[:whole], dtype="<u4").tolist():
        k = k * _M & _LOW
        h = (h * _M & _LOW) ^ ((k ^ k >> _R) * _M & _LOW)
    if tail := key[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * _M & _LOW
    h = (h ^ h >> 13) * _M & _LOW
    return h ^ h >> 15


def murmur2_all(keys: list[bytes]) -> np.ndarray:
    """murmur2 of each key; keys of one length go through at once, a word at a time."""
    out = np.zeros(len(keys), dtype=np.uint32)
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    m = np.uint32(_M)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        flat = np.frombuffer(b"".join([keys[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), n)
        h = np.full(len(rows), (_SEED ^ n) & _LOW, dtype=np.uint32)
        whole = n // 4 * 4
        for k in np.ascontiguousarray(flat[:, :whole]).view("<u4").T:
            k = k * m
            h = (h * m) ^ ((k ^ (k >> np.uint32(_R))) * m)
        if n > whole:
            tail = np.zeros(len(rows), dtype=np.uint32)
            for j in range(whole, n):
                tail |= flat[:, j].astype(np.uint32) << np.uint32(8 * (j - whole))
            h = (h ^ tail) * m
        h = (h ^ (h >> np.uint32(13))) * m
        out[rows] = h ^ (h >> np.uint32(15))
    return out


def long_key(key: Column) -> Column:
    """A long as the eight bytes that Kafka's serializer makes of it."""
    return F.unhex(F.lpad(F.hex(key.cast("bigint")), 16, "0"))


def kafka_partition(key: Column, partitions: int) -> Column:
    """Null keys have no partition."""
    if partitions <= 0:
        raise ValueError("partitions must be positive")

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        known = key.notna()
        out = pd.Series(index=key.index, dtype="Int32")
        out[known] = ((murmur2_all([bytes(b) for b in key[known]]) & np.uint32(0x7FFFFFFF)) % np.uint32(partitions)).astype("int32")
        return out

    return place(key.cast("binary"))
