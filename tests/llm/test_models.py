import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tarnflow.llm import annsearch, classifier, langid

from .helpers import clashing, docs, prose, rows

GERMAN = "der die und das nicht ist von mit den sich auf ein eine für als auch werden haben über durch zwischen schön größe".split()


def corpus():
    r = random.Random(6)
    out = []
    for i in range(160):
        if i % 2:
            out.append((i, prose(r, 60), "en", "a", 0))
        else:
            out.append((i, " ".join(r.choice(GERMAN) for _ in range(60)), "de", "a", 0))
    return out


def test_language_by_held_out_accuracy(spark):
    data = corpus() + [(500, None, "en", "a", 0), (501, "123 ½ !?", "de", "a", 0), (502, "", None, None, 0), (None, "the and of with", None, "a", 0), (503, "größe " * 30_000, None, None, 0), (504, "漢字", None, None, 0)]
    df = clashing(docs(spark, data))
    who = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identified(df, who).collect()}
    for i, _, lang, *_ in corpus():
        assert got[i]["lang_pred"] == lang and 0.5 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[500]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[503]["lang_pred"] == "de" and got[504]["lang_pred"] in ("en", "de")
    # What is held out isn't learnt: other labels there change nothing.
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in corpus()]
    assert langid.fit(docs(spark, swapped)).names == ["de", "en"]
    assert langid.fit(docs(spark, [])) is None
    assert {r["lang_pred"] for r in langid.identified(docs(spark), None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    words = Counter({"aba": 3, "abb": 2, "cab": 1, "b": 4})
    m = langid.train(words, 3)
    letters = "abc "
    for context in ("", "a", "ab", "ca"):
        total = 0.0
        for c in letters:
            # The probability of c after the word's start and the context, as the difference of two words' scores.
            full = langid.word_scores([m], [context + c], 3) if c != " " else None
            if c == " ":
                whole = langid.word_scores([m], [context], 3)[0, 0] if context else None
                prefix = _prefix(m, context)
                total += np.exp(whole - prefix) if context else 0.0
            else:
                total += np.exp(_prefix(m, context + c) - _prefix(m, context))
                assert full[0, 0] < 0
        assert 0.9 < total <= 1.0 + 1e-6, (context, total)


def _prefix(m, text):
    """Log-probability of the characters of text at a word's start, without its end."""
    if not text:
        return 0.0
    word, before, whole, contexts = langid.grams([text], 3)
    keep = slice(0, len(text))
    score, open_ = np.zeros(len(text)), np.ones(len(text), bool)
    for n in range(3, 0, -1):
        at = np.flatnonzero(open_ & (before[keep] >= n - 1))
        found = langid._find(m.grams[n - 1], whole[n - 1][at])
        score[at[found >= 0]] += m.logs[n - 1][found[found >= 0]]
        open_[at[found >= 0]] = False
        at = at[found < 0]
        c = langid._find(m.contexts[n - 1], contexts[n - 1][at])
        score[at[c >= 0]] += m.weights[n - 1][c[c >= 0]]
    score[open_] += np.log(langid.UNSEEN)
    return float(score.sum())


def plain_kneser_ney(counts, order):
    """p(history, character) by the definition, with dictionaries: histories are what stands before within the word."""
    spots = [(f" {w} ", i, n) for w, n in counts.items() for i in range(1, len(w) + 2)]
    table = {}
    for n in range(1, order + 1):
        grams = {}
        if n == order:
            for text, i, times in spots:
                if i >= n - 1:
                    g = text[i - n + 1 : i + 1]
                    grams[g] = grams.get(g, 0) + times
        else:
            for g in {text[i - n : i + 1] for text, i, _ in spots if i >= n}:
                grams[g[1:]] = grams.get(g[1:], 0) + 1
            for text, i, times in spots:
                if i == n - 1:
                    g = text[: i + 1]
                    grams[g] = grams.get(g, 0) + times
        ones, twos = (sum(c == k for c in grams.values()) for k in (1, 2))
        table[n] = grams, ones / (ones + 2 * twos) if ones and twos else 0.75

    def p(history, c, n):
        if n == 0:
            return langid.UNSEEN
        if len(history) < n - 1:
            return p(history, c, n - 1)
        context, (grams, discount) = history[len(history) - n + 1 :], table[n]
        beside = {g: x for g, x in grams.items() if g[:-1] == context}
        if not beside:
            return p(history, c, n - 1)
        total, held = sum(beside.values()), sum(min(x, discount) for x in beside.values())
        return max(0.0, beside.get(context + c, 0) - discount) / total + held / total * p(history, c, n - 1)

    return lambda word: sum(np.log(p(f" {word} "[:i], f" {word} "[i], order)) for i in range(1, len(word) + 2))


def test_word_scores_by_the_definition():
    r = random.Random(1)
    counts = Counter("".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(60))
    other = Counter(w[::-1] + "é" for w in counts)
    words = [*counts, *other, "dcba", "x", "aaaaaaaaaa", "zabz"]
    for order in (1, 2, 3, 4):
        got = langid.word_scores([langid.train(counts, order), langid.train(other, order)], words, order)
        plain = [plain_kneser_ney(c, order) for c in (counts, other)]
        want = np.array([[f(w) for f in plain] for w in words])
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4), order


def test_samples_are_of_different_texts(spark, monkeypatch):
    """Null ids, one id in every row, and copies of one row in most: each language still learns from its own different texts."""
    monkeypatch.setattr(langid, "SAMPLE", 20)
    data = corpus()
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    for rows_ in ([(None, *x[1:]) for x in data], [(one, *x[1:]) for x in data], data + [data[1]] * 500 + [data[0]] * 300):
        got = langid.sample(docs(spark, rows_)).collect()
        assert Counter(r["lang"] for r in got) == {"en": 20, "de": 20} and len({r["text"] for r in got}) == 40
    who = langid.fit(docs(spark, [(None, *x[1:]) for x in data]))
    found = langid.identified(docs(spark, data), who).collect()
    assert [r["lang_pred"] for r in sorted(found, key=lambda r: r["doc_id"])] == [x[2] for x in data]


def test_labelled_samples(spark, monkeypatch):
    """Labels repeated 3,000 times, labels of documents that are absent or too long, and repeated documents."""
    r = random.Random(2)
    data = [(i, f"text {i} " + prose(r, 20), "en", "a", 0) for i in range(120)] + [(200, "long " * 9000, "en", "a", 0)]
    learnt = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    labels = [(i, i % 2) for i in range(120)] + [(0, 0), (1, 1)] * 3000 + [(i, i % 2) for i in range(1000, 4000)] + [(200, 0), (5, 7), (6, None), (None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    for rows_ in (data, data + [data[2]] * 300 + [(i, data[4][1], "en", "a", 0) for i in range(300, 320)]):
        got = [(r["quality"], bytes(r["text"]).decode()) for r in classifier.sample(docs(spark, rows_), table).collect()]
        assert sorted(got) == sorted((i % 2, data[i][1]) for i in learnt)
    monkeypatch.setattr(classifier, "SAMPLE", 15)
    got = classifier.sample(docs(spark, data), table).collect()
    assert Counter(r["quality"] for r in got) == {0: 15, 1: 15} and len({bytes(r["text"]) for r in got}) == 30
    assert classifier.sample(docs(spark, data), table.filter("doc_id >= 1000")).collect() == []


def plain_odds(net, text):
    """The network by its definition: one window after the other."""
    c = classifier
    chunks = -(-(len(text) + c.WIDTH - c.STEP) // c.CHUNK)
    flat = [*text, *[256] * (chunks * c.CHUNK + c.WIDTH - len(text))]
    pools = np.zeros((chunks, c.FILTERS))
    for k in range(chunks):
        for w in range(c.WINDOWS):
            at = k * c.CHUNK + w * c.STEP
            if at + c.WIDTH > chunks * c.CHUNK:
                continue
            z = net.bias.astype(float).copy()
            for tap in range(c.TAPS):
                row = np.concatenate([net.embed[b] for b in flat[at + tap * c.STEP : at + (tap + 1) * c.STEP]])
                z += row.astype(float) @ net.filters[:, tap * c.FILTERS : (tap + 1) * c.FILTERS]
            pools[k] = np.maximum(pools[k], z)
    return float(np.concatenate([pools.max(axis=0), pools.mean(axis=0)]) @ net.weights + net.offset[0])


def test_network_by_plain_loops(monkeypatch):
    net = classifier.Network.new(5)
    r = np.random.default_rng(1)
    net.bias += r.normal(0, 0.3, classifier.FILTERS).astype(np.float32)
    sizes = [0, 1, 8, 243, 244, 247, 248, 249, 255, 256, 257, 500, 512, 520, 1024, 1027, 2000]
    texts = [bytes(r.integers(32, 127, n).tolist()) for n in sizes]
    want = [plain_odds(net, t) for t in texts]
    assert np.allclose(classifier.forward(net, texts)[0], want, atol=1e-4)
    for size in (256, 512):
        monkeypatch.setattr(classifier, "SLICE", size)
        assert np.allclose([classifier.long_odds(net, t) for t in texts[1:]], want[1:], atol=1e-4)
        p = classifier.probabilities(net, [t.decode() for t in texts])
        assert np.allclose(p, 1 / (1 + np.exp(-np.array(want))), atol=1e-5)


def test_memory_is_flat_over_a_long_text():
    import tracemalloc

    net, text = classifier.Network.new(5), "some words of a text " * 2_500_000
    tracemalloc.start()
    p = classifier.probabilities(net, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < p[0] < 1 and peak < 4 * len(text), peak / 1e6


def test_columns_of_any_name_stay(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    data = [(i, prose(r, 40) if i % 3 else " ".join(w.upper() + "!!" for w in prose(r, 40).split()), "en", "a", 0) for i in range(60)]
    names = ["_score", "score", "made", "made_", "key", "picked", "picked_key", "quality", "rank", "id"]
    table = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    df = docs(spark, data).withColumns({n: F.lit(7) for n in names})
    kept = classifier.keep(df, table)
    assert kept.columns == df.columns and {tuple(x) for x in kept.select(*names).distinct().collect()} == {(7,) * len(names)}


def test_gradients_by_differences():
    net = classifier.Network.new(3)
    texts = [b"hello there, this is a text. " * 30, b"x", b"", b"###%%%" * 50]
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        odds, _ = classifier.forward(net, texts)
        return float(np.logaddexp(0, -odds.astype(float) * (2 * y - 1)).sum())

    odds, kept = classifier.forward(net, texts)
    grads = classifier.backward(net, kept, (1 / (1 + np.exp(-odds)) - y).astype(np.float32))
    r = np.random.default_rng(0)
    for part, grad in list(zip(net.parts(), grads, strict=True))[1:]:
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in part.shape)
            old, eps = part[at], 2e-3
            part[at] = old + eps
            up = loss()
            part[at] = old - eps
            down = loss()
            part[at] = old
            assert abs((up - down) / (2 * eps) - grad[at]) < 0.03 * max(1, abs(grad[at])) + 0.03


def test_classifier_by_held_out_accuracy(spark):
    r = random.Random(3)
    data, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        data.append((i, prose(r, 80) if good else " ".join(w.upper() + "!!" for w in prose(r, 80).split()), "en", "a", 0))
        labels.append((i, int(good), 0))
    data += [x for x in rows() if x[0] is None or x[0] >= 1000]
    table = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    df = clashing(docs(spark, data))
    got = {r["doc_id"]: r["score"] for r in classifier.scored(df, classifier.fit(df, table), ["doc_id"]).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) >= 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    kept = classifier.keep(docs(spark, data), table)
    assert kept.columns == docs(spark, data).columns and 150 <= kept.count() <= 175
    assert classifier.fit(df, table.filter("quality = 1")) is None
    assert {r["score"] for r in classifier.scored(df, None, ["doc_id"]).collect()} == {0.5}
    assert classifier.scored(docs(spark, []), None, ["doc_id"]).collect() == []


def exact(data, k, every):
    ok = {i: np.array(v, float) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in ok:
        if q % every == 0:
            s = [(-round(float(ok[q] @ v / np.sqrt((ok[q] @ ok[q]) * (v @ v))), 12), i) for i, v in ok.items() if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_neighbours_by_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (6, 8))
    data = [(i, (centres[i % 6] + r.normal(0, 0.4, 8)).astype(np.float32).tolist()) for i in range(900)]
    data += [(1000 + i, data[7][1]) for i in range(150)]  # a hot vector
    data += [(2000, None), (2010, []), (2020, [0.0] * 8), (2030, [1.0] * 7 + [float("nan")]), (2040, [1.0] * 7 + [float("inf")]), (2050, [1.0] * 7 + [None]), (None, data[1][1]), (2060, [1.0, 2.0])]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    monkeypatch.setattr(annsearch, "BLOCK", 16)
    want = exact(data, 5, 10)
    for recall, least in ((1.0, 1.0), (0.95, 0.9)):
        got = {}
        for x in annsearch.nearest(df, every=10, recall=recall).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
        assert got.keys() == want.keys()
        hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / 5 for q, w in want.items()]
        assert np.mean(hits) >= least - (0.005 if recall == 1 else 0)
        for q, found in got.items():
            assert len(found) == 5 and q not in [i for i, _ in found]
            keys = [(-round(s, 12), i) for i, s in found]
            assert keys == sorted(keys)
    assert [i for i, _ in want[1000]] == [7, 1001, 1002, 1003, 1004]


def test_extreme_components():
    q, c = np.array([1e300, 1e300, 0.0]), np.array([[1e-300, 1e-300, 0.0], [1e300, 0.0, 0.0]])
    assert np.allclose(annsearch._cosines(q, c), [1, 0.5**0.5], atol=1e-15)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in annsearch.nearest(df).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert annsearch.nearest(df.limit(0)).collect() == [] and annsearch.nearest(df.filter("vec_id = 0")).collect() == []


def test_tree_walk_visits_every_leaf_once():
    x = annsearch._unit(np.random.default_rng(1).normal(0, 1, (2000, 6)))
    tree = annsearch.grow(x)
    leaves = list(tree.walk(x[0]))
    assert sorted(leaves) == list(range(tree.leaves)) and tree.leaves > 20
    assert set(tree.assign(x).tolist()) <= set(leaves)


def test_ties_of_different_vectors_go_by_id(spark):
    v = [1.0, 2.0, 0.5, -1.0, 0.25, 3.0, 1.5, 0.125]
    data = [(0, v)] + [(101 + i, [x * (1, 2, 4)[i % 3] for x in v]) for i in range(18)]
    got = annsearch.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [101, 102, 103, 104, 105] and len({r["score"] for r in got}) == 1


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    t = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.array(t["embedding"].tolist(), dtype=np.float64)
    ids = t["vec_id"].to_numpy()
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = annsearch.QUERIES["op8_ann_search"](spark, f"/root/testdata/sf{sf}")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found: dict = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    queries = np.flatnonzero(ids % 50 == 0)
    assert set(found) == set(ids[queries].tolist())
    hits = []
    for q in queries:
        s = unit @ unit[q]
        s[q] = -2
        mine = found[int(ids[q])]
        assert len(mine) == 5 and int(ids[q]) not in mine
        hits.append(len({int(i) for i in ids[np.lexsort((ids, -s))[:5]]} & set(mine)))
        assert all(abs(s[np.flatnonzero(ids == i)[0]] - score) < 1e-12 for i, score in mine.items())
    assert np.mean(hits) / 5 >= 0.9
