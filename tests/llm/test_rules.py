import random

import numpy as np
from tarnflow.llm import quality_rules as q

from .helpers import clashing, docs, prose, rows


def plain_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(q.SPACES)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return [len(words), sum(len(w.decode()) for w in words), sum(c in q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(inside), len(lines)]


def test_counts_by_brute_force(monkeypatch):
    r = random.Random(5)
    texts = [x[1] for x in rows()] + ["a b c d e f g h a b c d e f g h", "x y " * 50, "l\nl\n\n \nl\n l", "#*$%&|<> ok", "a b c d e f g\x1ch a b"]
    texts += [" ".join(r.choice("ab") for _ in range(60)) for _ in range(30)]
    texts += ["a\rb\r\nc\n\x0b\nd\x85e\u2028f\n\nd\x85e\u2028f"]
    want = [plain_counts(t) for t in texts]
    assert q.text_counts(texts).tolist() == want
    for size in (1, 7, 100):
        monkeypatch.setattr(q, "SLICE", size)
        assert q.text_counts(texts).tolist() == want


def corpus():
    r = random.Random(9)
    out = [(i, prose(r, r.randint(40, 300)), ["en", "de"][i % 2], "hot" if i % 3 else "b", 0) for i in range(400)]
    out += [(500 + i, " ".join(w + "%%%" for w in prose(r, 100).split()), "en", "hot", 0) for i in range(12)]
    return out + [x for x in rows() if x[0] is None or x[0] >= 1000]


def test_outliers_go_and_clean_documents_stay(spark):
    found = q.verdicts(clashing(docs(spark, corpus()))).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(corpus())
    assert all(got[i]["kept"] for i in range(400)), [i for i in range(400) if not got[i]["kept"]]
    assert not any(got[500 + i]["kept"] for i in range(12))
    assert got[1000]["n_words"] == 0 and got[1000]["base_failed"] and not got[1000]["kept"]
    for i, t, *_ in corpus():
        want = plain_counts(t)
        assert [got[i][c] for c in q.COUNTS[:5]] == want[:5]
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_kept_rows_have_the_columns_of_docs(spark):
    df = docs(spark, corpus())
    kept = q.keep(df)
    want = {r["doc_id"] for r in q.verdicts(df).filter("kept").collect()}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want
    assert q.keep(docs(spark, [])).collect() == [] and q.verdicts(docs(spark, [])).collect() == []


def plain_mcd(x):
    """The least determinant over the starts, with all distances sorted; then the reweighting."""
    floors = np.diag(np.array(list(q.FLOORS.values())) ** 2)
    quart = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    centre, spread = quart[1], np.maximum((quart[2] - quart[0]) / 1.349, list(q.FLOORS.values()))
    z = (x - centre) / spread
    norm = np.sqrt((z * z).sum(axis=1))
    corr = lambda y: np.corrcoef(y.T) * 0.999 + 0.001 * np.eye(q.P)
    half = x[np.argsort(norm, kind="stable")[: int(np.ceil(q.H * len(x)))]]
    scatter = lambda y, share: np.cov(y.T, bias=True) * q.consistency(share) + floors
    begin = [(centre, corr(y) * np.outer(spread, spread) + floors) for y in (np.tanh(z), z / np.maximum(norm, 1e-6)[:, None])]
    begin += [(half.mean(axis=0), scatter(half, q.H)), (centre, np.diag(spread**2) + floors)]
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for m, c in begin:
        for _ in range(q.STEPS):
            near = x[np.argsort(far(m, c), kind="stable")[: int(np.ceil(q.H * len(x)))]]
            m, c = near.mean(axis=0), scatter(near, q.H)
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c
    near = x[far(*best[1:]) <= q.quantile(q.REWEIGHTED, q.P)]
    m, c = near.mean(axis=0), scatter(near, q.REWEIGHTED)
    return m, c, far(m, c), best[0]


def test_least_determinant_by_sorted_distances(spark):
    """Histograms take whole bins, so shares differ by a little. A tight cluster of a third of the pool is shut out; so is a masked one along a correlation."""
    r = np.random.default_rng(0)
    data = {}
    x = r.normal(0, 1, (3000, q.P)) * [1, 0.2, 0.1, 0.1, 0.1]
    x[:, 1] += 0.15 * x[:, 0]
    data["third"] = x.copy()
    data["third"][:1000] = [4.0, 2.0, 1.0, 1.0, 1.0] + r.normal(0, 0.05, (1000, q.P))
    data["few"] = x.copy()
    data["few"][:40] += 8
    data["clean"] = x.copy()
    data["constant"] = np.ones((200, q.P))
    rows_ = [(k, *map(float, v)) for k, xs in data.items() for v in xs]
    stats = spark.createDataFrame(rows_, "pool string, " + ", ".join(f"{n} double" for n in q.NAMES))
    got = {r["pool"]: r["estimate"] for r in q.estimates(stats).collect()}
    assert got.keys() == data.keys()
    for k, xs in data.items():
        m, c, want, _ = plain_mcd(xs)
        centre, precision = np.array(got[k]["centre"]), np.array(got[k]["precision"]).reshape(q.P, q.P)
        have = np.einsum("ij,jk,ik->i", xs - centre, precision, xs - centre)
        assert np.abs(centre - m).max() < 0.1 and ((have <= q.CUT) == (want <= q.CUT)).mean() > 0.999, k
    out = {"third": 1000, "few": 40, "clean": 0, "constant": 0}
    for k, n in out.items():
        centre, precision = np.array(got[k]["centre"]), np.array(got[k]["precision"]).reshape(q.P, q.P)
        have = np.einsum("ij,jk,ik->i", data[k] - centre, precision, data[k] - centre)
        assert (have[:n] > q.CUT).all() and (have[n:] <= q.CUT).all(), k


def test_verdicts_by_brute_force(spark):
    """Every verdict of a corpus of one pool for each language and source, from plain counts and plain_mcd."""
    data = corpus()[:412]
    got = {r["doc_id"]: r for r in q.verdicts(docs(spark, data)).collect()}
    counts = {i: plain_counts(t) for i, t, *_ in data}

    def statistics(i):
        words, chars, symbols, dup, repeats, lines = counts[i]
        return [np.log1p(words), np.log((chars + 250) / (words + 50)), (symbols / max(chars, 1)) ** 0.5, (dup / max(lines, 1)) ** 0.5, repeats / max(words, 1)]

    for pool in {(d[2], d[3]) for d in data}:
        mine = [d[0] for d in data if (d[2], d[3]) == pool]
        assert len(mine) >= q.POOL_ROWS
        far = plain_mcd(np.array([statistics(i) for i in mine]))[2]
        for i, d2 in zip(mine, far, strict=True):
            failed = counts[i][0] < 20 or 100 * counts[i][4] > 30 * counts[i][0]
            assert got[i]["kept"] == (not failed and d2 <= q.CUT) or abs(d2 / q.CUT - 1) < 0.3


def test_clashing_columns_stay_as_they_are(spark):
    names = [*q.COUNTS, *q.NAMES, "pool", "centre", "precision", "estimate", "made", "made_", "of_lang", "of_source", "of_pool", "distance", "kept", "base_failed", "n", "bin", "norm", "start", "way", "score"]
    from pyspark.sql import functions as F

    df = docs(spark, corpus()).withColumns({n: F.lit(7) for n in names if n != "n_chars"})
    kept = q.keep(df)
    assert kept.columns == df.columns and kept.count() == q.keep(docs(spark, corpus())).count()
    assert {tuple(r) for r in kept.select(*[n for n in names]).distinct().collect()} == {(7,) * len(names)}


def test_chi_squared_quantiles():
    assert abs(q.quantile(0.975, 5) - 12.8325) < 1e-3 and abs(q.quantile(1 - 1e-6, 5) - q.CUT) < 0.1 and abs(q.quantile(0.5, 1) - 0.4549) < 1e-3
