import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tarnflow.llm import packing, simple8b, tokenfile
from tarnflow.llm.tokens import TextIds, default_vocabulary

from .helpers import clashing, docs, rows

VOCABULARY = default_vocabulary()


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.just(0), max_size=1500))
def test_simple8b_round_trip(values):
    words, offsets, escapes = simple8b.encode(np.array(values, dtype=np.uint64))
    assert simple8b.decode(words, offsets, escapes, len(values)).tolist() == values
    if values and max(values) == 0:
        assert len(words) <= len(values) // 120 + 2 * len(offsets)


def test_ids_equal_the_library():
    e = TextIds(VOCABULARY, limit=50)  # so that the memory is cleared often
    odd = ["Don't STOP! É İstanbul ΑΣ x ́a áb 12½ ª²³ ß ẞ ×÷ µ <|endoftext|> q", "", "  \n", "''s'll'd 'S 'RE can'T", "a\x1cb\x85c d", "漢字 テスト"]
    r = random.Random(3)
    odd += ["".join(r.choice("aäB'sß1½ \n.,!AKé́Σ|<>") for _ in range(80)) for _ in range(200)]
    for t in odd + [x[1] for x in rows()]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library_ids(t), t


def test_token_files(spark, tmp_path):
    data = rows()
    got = tokenfile.token_file(clashing(docs(spark, data))).collect()
    assert len(got) == len(data)
    want = sorted((zlib.crc32(np.array(library_ids(t) + [2], "<u4").tobytes()), -1 if i is None else i) for i, t, *_ in data)
    assert sorted((r["ids_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tokenfile.token_file(docs(spark, [])).collect() == []


def test_one_id_in_most_rows_is_spread_over_files(spark, tmp_path):
    from pyspark.sql import functions as F

    least = -(1 << 63)
    df = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 2 > 0, F.lit(least)).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = tokenfile.write(df, str(tmp_path), VOCABULARY, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenfile.read(spark, str(tmp_path), files).collect()
    assert len(files) == 4 and max(n for _, n in files) < 0.5 * sum(n for _, n in files)
    count = {i: sum(r["doc_id"] == i for r in got) for i in (None, 5, least)}
    assert count == {i: df.filter(F.col("doc_id").eqNullSafe(i)).count() for i in count} and len(got) == 4000
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_a_document_over_several_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 100)
    sizes = [0, 5, 250, 100, 95, 1000, 1]
    ids = [np.random.default_rng(i).integers(0, 49_000, n).astype("<u4").tobytes() for i, n in enumerate(sizes)]
    with open(tmp_path / "x", "wb") as f:
        w = tokenfile.SegmentWriter(f)
        for i, x in enumerate(ids):
            w.add(None if i == 3 else i, x)
        w.flush()
    with open(tmp_path / "x", "rb") as f:
        got = list(tokenfile.read_documents(f))
    assert [(g[0], g[2], g[3]) for g in got] == [(None if i == 3 else i, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(ids)]
    assert [g[1] for g in got] == np.cumsum([0, *sizes[:-1]]).tolist()


def test_nnls_finds_exact_repeats():
    a = packing.combinations()
    x = np.zeros(a.shape[1])
    x[[3, 50, 200]] = [10, 7, 21]
    got = packing.nnls(a, a @ x)
    assert np.abs(a @ got - a @ x).max() < 1e-6 and got.min() >= 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 4095), max_size=400))
def test_blocks_lose_nothing(lengths):
    made = packing.pack_block(np.array(lengths, dtype=np.int64)) if lengths else []
    totals = [sum(p[2] for p in s) for s in made]
    assert all(t == 4096 or t & (t - 1) == 0 and t <= 4096 for t in totals)
    parts = defaultdict(list)
    for s in made:
        for d, a, n in s:
            parts[d].append((a, n))
    assert len(parts) == len(lengths)
    for d, x in parts.items():
        at = 0
        for a, n in sorted(x):
            assert a == at and n > 0
            at += n
        assert at == lengths[d]


def test_packing(spark):
    data = [x for x in rows() if x[0] not in (None, 1003)]
    got = packing.pack(clashing(docs(spark, data))).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    for i, text, *_ in data:
        ids = np.array(library_ids(text) + [2], "<u4")
        at = 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(docs(spark, [])).collect() == []
    assert sum(r["length"] for r in packing.pack(docs(spark)).collect()) == sum(len(library_ids(x[1])) + 1 for x in rows())
