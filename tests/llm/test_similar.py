import random

import numpy as np
import pytest
from corpus_pipeline import near_dedup
from tarnflow.llm import simhash, similar

from .helpers import clashing, docs, prose, rows
from .test_simhash import corpus


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def groups(data):
    """The component_id of each row, by comparing all sets."""
    sets = [shingles(x[1]) for x in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(data):
        if x[0] is not None:
            least[find(i)] = min(least.get(find(i), x[0]), x[0])
    return [least.get(find(i)) for i in range(len(data))]


def edited(seed=5):
    """Copies with one to eight changed words of 150, so of similarities from 0.95 down to 0.6, and parts of texts."""
    r = random.Random(seed)
    out = corpus()
    for g in range(12):
        base = prose(r, 150).split()
        out.append((3000 + 20 * g, " ".join(base), "en", "a", 0))
        for k in range(1, 8):
            words = list(base)
            for at in r.sample(range(150), k):
                words[at] = f"other{r.random()}"
            out.append((3000 + 20 * g + k, " ".join(words), "en", "a", 0))
        out.append((3000 + 20 * g + 9, " ".join(base[: r.randint(100, 140)]), "en", "a", 0))
    for k in range(4, 14):  # few shingles
        words = prose(r, k).split()
        out += [(4000 + 2 * k, " ".join(words), "en", "a", 0), (4001 + 2 * k, " ".join([*words, "more"]), "en", "a", 0)]
    return out


@pytest.mark.parametrize(("tile", "sets"), [(4096, 512), (8, 4)])
def test_all_similar_texts_are_linked(spark, monkeypatch, tile, sets):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "SETS", sets)
    data = edited()
    got = similar.similar(clashing(docs(spark, data))).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(str((x[0], w)) for x, w in zip(data, groups(data), strict=True))


def test_pipeline_stage_drops_copies_of_similarity_four_fifths(spark):
    data = edited()
    stay = [r["doc_id"] for r in near_dedup(spark, docs(spark, data), "").collect()]
    assert sorted(x for x in stay if x is not None) == sorted({w for w in groups(data) if w is not None})
    assert stay.count(None) == 1
    assert near_dedup(spark, docs(spark, []), "").collect() == []


@pytest.mark.parametrize("keep", [similar.keep, simhash.keep])
def test_texts_of_a_repeated_id_are_judged_each_for_itself(spark, keep):
    r = random.Random(7)
    a, b, c, d = (prose(r, 150) for _ in range(4))
    # 2 has a copy of 1 and a text of its own; 5 is the least of two groups; 8 has the same text twice.
    data = [(1, a), (2, a.upper()), (2, b), (5, c), (5, d), (6, c.upper()), (7, d.upper()), (8, "x y z " + b[::-1]), (8, "x y z " + b[::-1])]
    stay = keep(docs(spark, [(i, t, "en", "a", 0) for i, t in data])).collect()
    assert sorted((x["doc_id"], x["text"]) for x in stay) == sorted([(1, a), (2, b), (5, c), (5, d), (8, data[-1][1])])


def test_a_sieve_holds_all_its_keys(spark):
    import numpy as np
    from tarnflow.llm import common

    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    words = common.sieve(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert common.sieved(words, keys).all()
    assert common.sieved(words, np.random.default_rng(2).integers(-(2**63), 2**63, 20_000)).mean() < 0.05
    assert not common.sieved(common.sieve(spark.createDataFrame([], "key long")), keys).any()


def drawn(n, near, seed=3):
    """Fingerprints of 192 bits, and near copies of the first ones with 1 to 60 bits changed."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, (n, similar.WORDS), dtype=np.uint64)
    bits = np.unpackbits(base[:near].view(np.uint8), axis=1, bitorder="little")
    for row, d in zip(bits, r.integers(1, 61, near), strict=True):
        row[r.permutation(64 * similar.WORDS)[:d]] ^= 1
    return np.concatenate([base, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)])


@pytest.mark.parametrize("nodes", [100, 10_000, 65_536])
@pytest.mark.parametrize("own", [True, False])
def test_all_fingerprints_within_the_distance_meet(monkeypatch, nodes, own):
    """Candidates of near-dedup come from the generalised pigeonhole search, against all pairs."""
    monkeypatch.setattr(similar, "PAIRS", 500)
    fp = drawn(500, 200)
    partitions = similar.plan(fp, nodes, similar.DISTANCE)
    assert sum(t + 1 for _, t in partitions) == similar.DISTANCE + 1
    used = [b for bits, _ in partitions for b in bits]
    assert len(set(used)) == len(used)
    left = np.arange(len(fp)) if own else np.arange(500)
    right = left if own else np.arange(500, len(fp))
    label = similar.search(fp, np.full(len(fp), 100), left, right, partitions, 0.8)
    apart = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2)
    for a, b in zip(*np.nonzero(apart <= similar.DISTANCE), strict=True):
        assert label[a] == label[b]
    for a, b in zip(range(500, 700), range(200), strict=True):
        assert label[a] != label[b] or apart[a, b] <= similar.WIDE


def test_blocks_that_may_be_similar_meet():
    bins = [(k, n, k, k + 3) for k, n in zip(range(4, 400, 4), [1, 30, 3, 2, 17, 9] * 20, strict=False)]
    spans = similar.blocks(bins, 10, 0.8)
    assert [x[0] for x in spans] == [x[0] for x in bins]
    for (_, n, lo, hi), (_, at, parts, first, last) in zip(bins, spans, strict=True):
        assert parts == max(1, -(-n // 10)) and first <= at and at + parts - 1 <= last
        for (_, _, low, high), (_, to, more, *_) in zip(bins, spans, strict=True):
            if 0.8 * max(lo, low) <= min(hi, high):
                assert first <= to and to + more - 1 <= last


def test_a_passage_repeated_in_one_of_two_texts(spark):
    """Similarity is of sets, so fingerprints are, too: they don't move if a passage comes a hundred times."""
    r = random.Random(11)
    body, line = prose(r, 150), " qua sed non sit nec"
    data = [(1, body + line * 100), (2, "another start " + body + line * 2), (3, prose(r, 150) + line * 100)]
    got = similar.similar(docs(spark, [(i, t, "en", "a", 0) for i, t in data])).collect()
    assert groups(data) == [1, 1, 3]
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 1), (2, 1), (3, 3)]
