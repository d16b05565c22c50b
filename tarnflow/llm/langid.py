"""Language identification: an interpolated Kneser-Ney character model for each language.

Words (runs of letters, lower case, with a space on either side) are scored by character n-grams up to ORDER. A model
is sorted arrays of hashed n-grams with their interpolated log-probabilities and of hashed contexts with the weights
of the next lower order. A text's cross-entropy under a language is its words' sum divided by its characters; the least
one wins. On sampled documents kept from the models, a scale is fitted that turns the languages' cross-entropies into
probabilities, and a bar that all but REJECT of the rightly labelled ones pass; `rejected` marks texts below it. The
evidence grows with the root of a text's characters, but not beyond SURE of them, as characters aren't independent: that
bounds how sure a score gets, never what is read.

The models are fitted on at most SAMPLE different texts of each language of at most SAMPLE_BYTES bytes, those with the
least hashes of the text, so that repeated texts and null or repeated doc_ids count once; prediction reads nothing but
the text, whole. Null texts and texts without letters are `und` with
score 0. Null languages teach nothing; without any labelled row all is `und`. Repeated rows have equal results, an
empty table gives none, other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .classifier import remainder
from .common import arrow_rows, pieces, table

ORDER = 4
SAMPLE, SAMPLE_BYTES = 400, 32_768
#: The odds of a character that no model has seen.
UNSEEN = 1 / 4096
REJECT, SURE = 0.01, 400
REMEMBERED = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
SALT = 20_011


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each character after a word's first space: its word, whether k characters stand before it within the word
    (as their number), the hashes of the n-grams that end with it, and of their contexts, n = 1 to order."""
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place > 0)
    before = np.minimum(place[at], order - 1)
    contexts, whole = [], []
    for n in range(1, order + 1):
        context = np.full(len(at), n, dtype=np.uint64)
        for back in range(n - 1, 0, -1):
            context = (context ^ codes[np.maximum(at - back, 0)]) * _MIX
            context ^= context >> np.uint64(32)
        contexts.append(context)
        gram = (context ^ codes[at] ^ np.uint64(1 << 40)) * _MIX
        whole.append(gram ^ (gram >> np.uint64(29)))
    return word[at], before, whole, contexts


@dataclass
class Model:
    """Sorted hashes of n-grams and contexts of each order, with log-probabilities and log-weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)


def train(counts: Counter, order: int = ORDER) -> Model:
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], dtype=np.float64)
    model = Model()
    if not words:
        return model
    word, before, whole, contexts = grams(words, order)
    times = weight[word]
    lower = np.zeros(0)  # log-probability of each position's next lower n-gram
    for n in range(1, order + 1):
        full = before >= n - 1
        g, c, t, b = whole[n - 1][full], contexts[n - 1][full], times[full], before[full]
        if n < order:
            # Continuation counts: in how many contexts, one character longer, the n-gram occurs; at a word's start, where there is none, its count.
            longer = np.where(b >= n, whole[n][full], g)
            distinct, at = np.unique(longer, return_index=True)
            size = np.where(b[at] >= n, 1.0, 0.0)
            keys, inverse = np.unique(g[at], return_inverse=True)
            count = np.bincount(inverse, size)
            start = np.zeros(len(keys))
            np.add.at(start, np.searchsorted(keys, g[b < n]), t[b < n])
            count = count + start
        else:
            keys, inverse = np.unique(g, return_inverse=True)
            count = np.bincount(inverse, t)
        first = np.unique(g, return_index=True)[1]
        of_context = c[first]
        ones, twos = float((count == 1).sum()), float((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        known, which = np.unique(of_context, return_inverse=True)
        total = np.bincount(which, count)
        held = np.bincount(which, np.minimum(count, discount))
        gamma = held / total
        shorter = np.full(len(first), UNSEEN) if n == 1 else np.exp(lower[full][first])
        p = (count - np.minimum(count, discount)) / total[which] + gamma[which] * shorter
        model.grams.append(keys)
        model.logs.append(np.log(p).astype(np.float32))
        model.contexts.append(known)
        model.weights.append(np.log(gamma).astype(np.float32))
        now = np.zeros(len(full)) if n == 1 else lower.copy()
        now[full] = np.log(p)[np.searchsorted(keys, g)]
        lower = now
    return model


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places, -1 if missing."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def word_scores(models: list[Model], words: list[str], order: int = ORDER) -> np.ndarray:
    """words x languages: the log-probability of each word."""
    word, before, whole, contexts = grams(words, order)
    out = np.zeros((len(words), len(models)))
    for k, m in enumerate(models):
        if not m.grams:
            out[:, k] = np.bincount(word, minlength=len(words)) * np.log(UNSEEN)
            continue
        score = np.zeros(len(word))
        open_ = np.ones(len(word), bool)
        for n in range(order, 0, -1):
            at = np.flatnonzero(open_ & (before >= n - 1))
            found = _find(m.grams[n - 1], whole[n - 1][at])
            hit = found >= 0
            score[at[hit]] += m.logs[n - 1][found[hit]]
            open_[at[hit]] = False
            at = at[~hit]
            context = _find(m.contexts[n - 1], contexts[n - 1][at])
            seen = context >= 0
            score[at[seen]] += m.weights[n - 1][context[seen]]
        score[open_] += np.log(UNSEEN)
        out[:, k] = np.bincount(word, score, minlength=len(words))
    return out


class Scorer:
    """Cross-entropy of texts under each model; scores of words seen are remembered."""

    def __init__(self, models: list[Model]):
        self.models, self.known = models, {}
        self.table = np.zeros((0, len(models) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        rows = np.zeros((len(words), len(self.models) + 1), np.float32)
        real = [i for i, w in enumerate(words) if any(map(str.isalpha, w))]
        if real:
            rows[real, :-1] = word_scores(self.models, [words[i] for i in real])
            rows[real, -1] = [len(words[i]) + 1 for i in real]
        at = len(self.known)
        if len(self.table) < at + len(words):
            self.table = np.concatenate([self.table[:at], np.zeros((max(at, len(words) + 1024), rows.shape[1]), np.float32)])
        self.table[at : at + len(words)] = rows
        self.known.update((w, at + i) for i, w in enumerate(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages cross-entropies, characters of each)"""
        words = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for ws in words for w in ws if w not in self.known))
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                fresh = list(dict.fromkeys(w for ws in words for w in ws))
            self._learn(fresh)
        sizes = np.array([len(w) for w in words])
        ids = np.fromiter((self.known[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
        total = np.zeros((len(texts), self.table.shape[1]))
        doc = np.repeat(np.arange(len(texts)), sizes)
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(doc, self.table[ids, k], minlength=len(texts))
        n = total[:, -1]
        return -total[:, :-1] / np.maximum(n, 1)[:, None], n


@dataclass
class Identifier:
    names: list[str]
    models: list[Model]
    scale: float = 1.0
    bar: float = 0.0

    def confidence(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -entropy * (self.scale * np.sqrt(np.minimum(n, SURE)))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def calibrate(who: Identifier, texts: list[str], langs: list[str]) -> None:
    entropy, n = Scorer(who.models)(texts)
    truth = np.array([who.names.index(x) for x in langs])
    use = n > 0
    if not use.any():
        return
    entropy, n, truth = entropy[use], n[use], truth[use]
    rows = np.arange(len(truth))

    def loss(scale: float) -> float:
        who.scale = scale
        return float(-np.log(np.maximum(who.confidence(entropy, n)[rows, truth], 1e-9)).mean())

    who.scale = min((0.05 * 1.25**k for k in range(24)), key=loss)
    right = entropy.argmin(axis=1) == truth
    sure = who.confidence(entropy, n).max(axis=1)[right]
    who.bar = float(np.quantile(sure, REJECT)) if len(sure) else 0.0


def sample(docs: DataFrame) -> DataFrame:
    """lang, text: at most SAMPLE different texts of each language, without the rows held out."""
    usable = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(remainder("doc_id", 4), F.lit(0)) != 2) & (F.octet_length("text") <= SAMPLE_BYTES))
    hash_ = F.xxhash64("text", F.lit(SALT))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(hash_).alias("n")).collect()}  # a row for each language
    # Four times as many as wanted are drawn, so that few texts are moved; the rank then takes the exact number.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * SAMPLE / max(1, n)))]) if counts else F.create_map().cast("map<string,double>")
    drawn = usable.filter(F.pmod(hash_, F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(SALT + 1)), "text"))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).drop("rank")


def fit(docs: DataFrame) -> Identifier | None:
    """From docs (doc_id, text, lang), without the rows held out."""
    rows = sorted(sample(docs).collect(), key=lambda r: (r["lang"], r["text"]))  # at most SAMPLE of each language
    counts = Counter(r["lang"] for r in rows)
    if not counts:
        return None
    names = sorted(counts)
    words: dict[str, Counter] = {k: Counter() for k in names}
    spare: list = []
    for i, r in enumerate(rows):
        if i % 5 == 4:
            spare.append(r)
        else:
            words[r["lang"]].update(w for w in LETTERS.findall(r["text"].lower()) if any(map(str.isalpha, w)))
    who = Identifier(names, [train(words[k]) for k in names])
    if spare:
        calibrate(who, [r["text"] for r in spare], [r["lang"] for r in spare])
    return who


def identified(docs: DataFrame, who: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each of docs (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(who)  # a few MB for each language

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = sent.value
        scorer = Scorer(who.models) if who else None
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = batch.column(1).to_pylist()
                names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if who:
                    entropy, n = scorer(texts)
                    sure = who.confidence(entropy, n)
                    best = entropy.argmin(axis=1)
                    names = [who.names[b] if m else "und" for b, m in zip(best.tolist(), n > 0, strict=True)]
                    scores = np.where(n > 0, sure[np.arange(len(texts)), best], 0.0)
                    rejected = (n == 0) | (scores < who.bar)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identified(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language_id": op7_language_id}
