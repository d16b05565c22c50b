import random

import numpy as np
import pytest
from tarnflow.llm import simhash
from tarnflow.llm.components import components
from xxhash import xxh64_intdigest

from .helpers import clashing, docs, prose, rows


def plain_fingerprint(text, n=4):
    words = [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def corpus():
    r = random.Random(2)
    out = rows()
    base = prose(r, 150).split()
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed"
        out.append((2000 + i, " ".join(words), "en", "a", 0))
    return out


def test_fingerprints():
    for t in [x[1] for x in corpus()] + ["One Two", "a b c d", "ÀÉ a\xa0b c d e"]:
        assert simhash.text_fingerprint(t) == plain_fingerprint(t)


def test_components_of_documents(spark):
    data = corpus()
    got = simhash.near_duplicates(clashing(docs(spark, data))).collect()
    assert len(got) == len(data)
    want = groups([x[0] for x in data], [plain_fingerprint(x[1]) for x in data])
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((x[0], w)) for x, w in zip(data, want, strict=True))
    stay = [r["doc_id"] for r in simhash.keep(docs(spark, data)).collect()]
    assert sorted(x for x in stay if x is not None) == sorted({w for w in want if w is not None}) and stay.count(None) == 1
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def distinct(spark, fps):
    return spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, least long")


@pytest.mark.parametrize(("distance", "tile"), [(4, 4096), (4, 8), (7, 4096), (7, 8)])
def test_links_lose_none(spark, monkeypatch, distance, tile):
    """Clusters, chains and noise, in whole buckets and in tiles, with unequal thresholds."""
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(distance)
    fps = {r.getrandbits(64) for _ in range(150)} | {0}
    for f in list(fps)[:30]:
        for _ in range(8):
            for _ in range(r.randint(1, distance + 1)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = distinct(spark, fps)
    partitions = simhash.plan(df, distance)
    assert sum(t + 1 for _, t in partitions) == distance + 1
    if distance == 7:
        partitions = [(bits, 1) for bits in np.array_split(range(64), 4)]
        partitions = [([int(b) for b in bits], t) for bits, t in partitions]
    found = {r["node"]: r["root"] for r in components(simhash.links(df, partitions, distance)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = groups(signed, fps, distance)
    assert [found.get(x, x) for x in signed] == want


def test_allocation_is_the_least_cost():
    from itertools import product

    r = random.Random(1)
    costs = [[0.0, *sorted(r.random() for _ in range(5))] for _ in range(4)]
    least = min(sum(c[t] for c, t in zip(costs, ts, strict=True)) for ts in product(range(6), repeat=4) if sum(ts) == 5)
    cost, thresholds = simhash.allocate(costs, 5)
    assert abs(cost - least) < 1e-12 and sum(t + 1 for t in thresholds) == 5


def test_stars_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
