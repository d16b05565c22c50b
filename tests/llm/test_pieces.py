import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tarnflow.llm import pieces_lattice as pl

from .helpers import clashing, docs, rows

MODEL = pl.default_model()
ODD = ["Hello world", "  a  b ", "x\n\ny\tz", "é漢字\x01😀", "", " ", "<s> </s> <0x41>", "ﬁ ａ", "a" * 1000, "ab" * 700 + " x", " " * 40, "            indent\n    foo", "the" * 120]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(library):
    e = pl.Encoder(MODEL)
    texts = ODD + [x[1] or "" for x in rows()] + ["▁a"]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == library.encode(texts)
    assert [e.pieces.decode(x) for x in got] == [library.decode(x) for x in got]


def test_long_words_merge_alike():
    p = pl.Pieces(MODEL)
    for w in ("theaterinthe" * 15, "aaaabaab" * 20, "▁▁▁the"):
        ids = [x for s in pl.merged_by_heap(w, p.normal, p.scores) for x in p._ids(s)]
        assert np.frombuffer(p.encode_words([w])[0], "<u4").tolist() == ids


def test_query_form(spark, library):
    data = rows()
    got = {(r["doc_id"], r["ids_crc32"]): r for r in pl.encode(clashing(docs(spark, data)), digest=True).collect()}
    for i, t, *_ in data:
        ids = library.encode(t or "")
        r = got[i, zlib.crc32(np.array(ids, "<u4").tobytes())]
        assert r["n_pieces"] == len(ids) and r["decodes"]
    back = pl.decode(pl.encode(docs(spark, data))).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t, *_ in data)
    assert pl.encode(docs(spark, [])).collect() == []


def unigram(vocabulary):
    p = pl.Pieces(MODEL)
    p.names, p.bpe, p.bytes, p.unk, p.special = ["<unk>", *vocabulary], False, {}, 0, set()
    p.normal = {w: i + 1 for i, w in enumerate(vocabulary)}
    p.scores = np.array([0.0, *vocabulary.values()])
    p.most = max(map(len, vocabulary))
    p.codes = np.zeros((len(p.names), p.most), np.uint32)
    by = {}
    for w, i in p.normal.items():
        p.codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
        by.setdefault(len(w), []).append(i)
    p.by_length, p.sieves = {}, {}
    for k, ids in by.items():
        h = np.zeros(len(ids), np.uint64)
        for j in range(k):
            h = (h ^ p.codes[ids, j]) * pl._MIX
        order = np.argsort(h)
        p.by_length[k] = h[order], np.array(ids)[order]
        p.sieves[k] = np.zeros(1 << pl.SIEVE, bool)
        p.sieves[k][h >> np.uint64(64 - pl.SIEVE)] = True
    return p


def best_path(word, vocabulary):
    best = None
    for cut in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in vocabulary or len(p) == 1 for p in parts):
            score = sum(vocabulary.get(p, -1e6) for p in parts)
            if best is None or score > best[0]:
                best = score, parts
    return best[1]


VOCABULARY = {"a": -3.0, "b": -3.1, "ab": -4.0, "abc": -7.3, "bc": -4.5, "c": -5.0, "cab": -4.2, "▁": -2.0, "▁ab": -5.5, "bca": -6.05}
TRIED = ["▁abcab", "abcabc", "cabbca", "▁▁abx", "x", "bcabcabx"]


def test_viterbi_is_the_best_path():
    p = unigram(VOCABULARY)
    for word, packed in zip(TRIED, p.encode_words(TRIED), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == [p.normal.get(s, 0) for s in best_path(word, VOCABULARY)], word


def test_native_lattice_is_the_best_path(spark):
    words = spark.createDataFrame([(w,) for w in [*TRIED, TRIED[0]]], "word string")
    table = spark.createDataFrame([(w, i, s) for i, (w, s) in enumerate(VOCABULARY.items())], "piece string, id int, score double")
    got = {r["word"]: r["symbols"] for r in pl.lattice_native(words, table, 4).collect()}
    assert got == {w: best_path(w, VOCABULARY) for w in TRIED}


def test_native_merges_are_the_library_s(spark):
    """Over words of the tables and odd ones, with the pieces of the model at hand."""
    r = random.Random(4)
    texts = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    e = pl.Encoder(pl.default_model())
    words = sorted({w.replace(" ", pl.SPACE) for t in texts[:40] for w in e.words(t)} | {"".join(r.choice("thein▁éß漢1a") for _ in range(r.randint(1, 30))) for _ in range(200)} | {"▁" + "a" * 60, "x" * 62, "▁"})
    got = {x["word"]: x["symbols"] for x in pl.lattice_native(spark.createDataFrame([(w,) for w in words], "word string"), pl.piece_table(spark), e.pieces.most, bpe=True).collect()}
    assert got.keys() == {w for w in words if len(w) <= pl.MASKED}
    packed = dict(zip(words, e.pieces.encode_words(words), strict=True))
    for w, symbols in got.items():
        assert [i for x in symbols for i in e.pieces._ids(x)] == np.frombuffer(packed[w], "<u4").tolist(), w
