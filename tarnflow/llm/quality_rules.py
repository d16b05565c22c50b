"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Pass one counts words, symbols, repeated lines and repeated 8-word windows of each whole text. The counts become a
vector of five transformed statistics. For each pool of documents (a language and source with POOL_ROWS rows at least;
smaller ones share the pool of their language, then one pool of all) the minimum covariance determinant is sought over
all rows. There are four deterministic starts, from medians and quartiles: no correlation, the correlation of the
statistics' hyperbolic tangents, that of their directions from the centre, and the moments of the nearest share. From
each, concentration steps: distances under the present centre and scatter, the nearest share H of the pool by a
histogram of distances, new centre and scatter from the moments of its bins. The start whose scatter has the least
determinant after STEPS of them is kept, and reweighted once. Moments are pre-aggregated before they are shuffled, so a
pool of a third of all rows costs its tasks no more than any other. A document is rejected if the base rules fail it or
its squared Mahalanobis distance is over CUT.

The nearest share is of whole bins, so it is somewhat more than H, and all of equal vectors. Null and empty texts have
zero words and fail the base rules. Null lang or source are values of their own. Repeated rows count as often as they
occur; pools of under POOL_ROWS rows in all have no estimate and keep what the base rules keep. An empty table gives no
rows. Other columns are not read; `keep` passes them on, whatever their names.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, free_name, kept, pieces, table, tidy

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\v\f\r "
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text whose words are objects at once.
SLICE = 1 << 20
WINDOW_WORDS = 8
POOL_ROWS, H, STEPS = 40, 0.6, 4
#: The statistics of the vector and the least standard deviation each is given; most documents have no symbols or repeats at all.
FLOORS = {"size": 0.5, "word_size": 0.05, "symbols": 0.04, "dup_lines": 0.14, "repeats": 0.1}
NAMES = list(FLOORS)
P = len(NAMES)
#: Squared distance beyond which a vector is rejected: the chi-squared quantile for five statistics at 1 - 1e-6.
CUT = 35.9
#: Share of normal vectors within the distance of the reweighting.
REWEIGHTED = 0.975
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def word_codes(text: str) -> np.ndarray:
    """A hash of each word, by slices, so that a long text's words are never all objects at once."""
    data, out, at = text.encode(), [], 0
    while at < len(data):
        end = _SPACE.search(data, at + SLICE) if at + SLICE < len(data) else None
        to = end.start() if end else len(data)
        mine = data[at:to].split()
        out.append(np.fromiter(map(hash, mine), dtype=np.int64, count=len(mine)))
        at = to
    return np.concatenate(out).view(np.uint64)


def text_counts(texts: list[str | None]) -> np.ndarray:
    """rows x COUNTS."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    codes: list[np.ndarray] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        codes.append(word_codes(text))
        lines, seen = 0, set()
        for line in io.StringIO(text, newline="\n"):
            line = line.removesuffix("\n")
            if line.strip(SPACES):
                lines += 1
                seen.add(line)
        out[i] = len(codes[-1]), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), lines - len(seen), 0, lines
    code = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
    n = len(code)
    if n >= WINDOW_WORDS:
        doc = np.repeat(np.arange(len(texts)), out[:, 0])
        ends = np.cumsum(out[:, 0])
        windows = n - WINDOW_WORDS + 1
        key = np.zeros(windows, dtype=np.uint64)
        for j in range(WINDOW_WORDS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (code[j : j + windows] ^ (code[j : j + windows] >> np.uint64(29)))
        whole = np.arange(windows) + WINDOW_WORDS <= ends[doc[:windows]]
        at = np.flatnonzero(whole)
        key = (key[at] ^ (key[at] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + doc[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks = np.zeros(n + 1, dtype=np.int64)
        starts = at[twice]
        marks[starts] += 1
        np.add.at(marks, starts + WINDOW_WORDS, -1)
        covered = np.cumsum(marks[:n]) > 0
        out[:, 4] = np.bincount(doc[covered], minlength=len(texts))
    return out


_MADE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def with_counts(docs: DataFrame, columns: list[str], name: str = "made") -> DataFrame:
    """The columns of docs named, and COUNTS of the text as one more."""
    arrow_rows(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, _MADE)])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                counts = text_counts(batch.column(batch.schema.get_field_index("text")).to_pylist())
                made = pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + [made], names=[*columns, name])

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(tidy(each), schema)


def vector(name: str = "made") -> dict[str, Column]:
    made = F.col(name)
    words, chars, lines = made["n_words"], made["word_chars"], made["n_lines"]
    return {
        "size": F.log1p(words),
        "word_size": F.log((chars + 250) / (words + 50)),  # shrunk to five by fifty words, as short texts vary
        "symbols": F.sqrt(made["n_symbols"] / F.greatest(chars, F.lit(1))),
        "dup_lines": F.sqrt(made["n_dup_lines"] / F.greatest(lines, F.lit(1))),
        "repeats": made["n_repeat_words"] / F.greatest(words, F.lit(1)),
    }


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def quantile(p: float, k: int) -> float:
    """Of the chi-squared distribution with k degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(k / 2, mid / 2) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the scatter of the nearest share is multiplied with to be that of all, for normal vectors."""
    return share / gamma_p(P / 2 + 1, quantile(share, P) / 2)


def pools(stats: DataFrame) -> DataFrame:
    """lang, source, pool of each pair that occurs (null-safe keys)."""
    counts = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < POOL_ROWS, F.col("n")).otherwise(0)
    of_lang = counts.groupBy("lang").agg(F.sum(small).alias("n_small"))
    pair = F.concat_ws("\x1f", F.lit("pair"), F.coalesce("lang", F.lit("\x1e")), F.coalesce("source", F.lit("\x1e")))
    named = F.when(F.col("n") >= POOL_ROWS, pair).when(F.col("n_small") >= POOL_ROWS, F.concat_ws("\x1f", F.lit("lang"), F.coalesce("lang", F.lit("\x1e")))).otherwise(F.lit("rest"))
    of_lang = of_lang.withColumnRenamed("lang", "lang_")
    return counts.join(of_lang, F.col("lang").eqNullSafe(F.col("lang_"))).select("lang", "source", named.alias("pool"))


def distance(values: list[Column], estimate: Column) -> Column:
    """Squared Mahalanobis distance of the vector under an estimate (centre, precision)."""
    delta = [v - estimate["centre"][i] for i, v in enumerate(values)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + delta[i] * delta[j] * estimate["precision"][i * P + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


_ESTIMATE = "pool string, start int, estimate struct<centre:array<double>,precision:array<double>>, determinant double"
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
STARTS = 4


def symmetric(products: Iterable[float]) -> np.ndarray:
    out = np.zeros((P, P))
    out[np.triu_indices(P)] = list(products)
    return out + np.triu(out, 1).T


def _estimate(centre: np.ndarray, scatter: np.ndarray) -> tuple[dict, float]:
    """The estimate of a scatter, and its determinant; every statistic has the least deviation that it is given."""
    scatter = scatter + np.diag(np.array(list(FLOORS.values())) ** 2)
    return {"centre": centre.tolist(), "precision": np.linalg.inv(scatter).ravel().tolist()}, float(np.linalg.det(scatter))


def of_moments(n: float, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[dict, float]:
    """From the moments of the nearest share."""
    mean = np.array(sums) / n
    return _estimate(mean, (symmetric(products) / n - np.outer(mean, mean)) * consistency(share))


def of_correlation(n: float, sums: np.ndarray, products: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> tuple[dict, float]:
    """A start: the correlation of some transform of the standardised statistics, with their own spreads."""
    mean = np.array(sums) / n
    cov = symmetric(products) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.where(np.eye(P, dtype=bool), 1.0, cov / np.outer(sd, sd) * 0.999)
    return _estimate(centre, corr * np.outer(spread, spread))


def _moments(values: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in values]).alias("sums"), F.array(*[F.sum(values[i] * values[j]) for i, j in _PAIRS]).alias("products")]


def _nearest_share(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the bins (bin, n, sums, products) up to the one that reaches the share H."""
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    near = bins.filter(F.col("below") < F.col("all") * H)
    return near.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(P)]).alias("sums"), F.array(*[F.sum(F.col("products")[k]) for k in range(len(_PAIRS))]).alias("products"))


def bin_of(d2: Column) -> Column:
    return F.least(F.floor(8 * F.log2(1 + d2)), F.lit(255))


def starts(stats: DataFrame) -> DataFrame:
    """STARTS estimates of each pool."""
    first = stats.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in NAMES]).filter(F.col("rows") >= POOL_ROWS)
    spread = [F.greatest((F.col(n)[2] - F.col(n)[0]) / 1.349, F.lit(FLOORS[n])) for n in NAMES]
    robust = kept(first.select("pool", F.array(*[F.col(n)[1].cast("double") for n in NAMES]).alias("centre"), F.array(*spread).alias("spread")), "medians")
    z = [(F.col(n) - F.col("centre")[i]) / F.col("spread")[i] for i, n in enumerate(NAMES)]
    z = stats.join(robust, "pool").select("pool", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    zs = [F.col(f"z{i}") for i in range(P)]
    norm = sum((v * v for v in zs), F.lit(0.0))
    ways = [[F.tanh(v) for v in zs], [v / F.sqrt(F.greatest(F.col("norm"), F.lit(1e-12))) for v in zs], zs]
    found = None
    for way, values in enumerate(ways):
        rows = z.withColumn("norm", norm).select("pool", "norm", *[v.alias(f"z{i}") for i, v in enumerate(values)])
        if way < 2:
            moments = rows.groupBy("pool").agg(*_moments(zs))
        else:
            moments = _nearest_share(rows.groupBy("pool", bin_of(F.col("norm")).alias("bin")).agg(*_moments(zs)), ["pool"])
        moments = moments.withColumn("way", F.lit(way))
        found = moments if found is None else found.unionByName(moments)

    def each(frames: Iterable) -> Iterator:
        for f in frames:
            out: list[tuple] = []
            for r in f.itertuples(index=False):
                centre, spread = np.array(r.centre), np.array(r.spread)
                if r.way < 2:
                    made = of_correlation(r.n, r.sums, r.products, centre, spread)
                else:
                    mean = np.array(r.sums) / r.n
                    made = _estimate(centre + mean * spread, (symmetric(r.products) / r.n - np.outer(mean, mean)) * np.outer(spread, spread) * consistency(H))
                    out.append((r.pool, STARTS - 1, *_estimate(centre, np.diag(spread**2))))
                out.append((r.pool, r.way, *made))
            yield f.iloc[:0].reindex(columns=["pool", "start", "estimate", "determinant"]) if not out else type(f)(out, columns=["pool", "start", "estimate", "determinant"])

    return kept(found.join(robust, "pool").mapInPandas(each, _ESTIMATE), "starts")


def _concentrated(share: float):
    """Moments of pools and starts -> estimates."""

    def each(frames: Iterable) -> Iterator:
        for f in frames:
            made = [of_moments(r.n, r.sums, r.products, share) for r in f.itertuples(index=False)]
            yield f[["pool", "start"]].assign(estimate=[m[0] for m in made], determinant=[m[1] for m in made])

    return each


def estimates(stats: DataFrame) -> DataFrame:
    """pool, estimate, determinant from stats (pool and the vector's columns)."""
    values = [F.col(n) for n in NAMES]
    now = starts(stats)
    keys = ["pool", "start"]
    for _ in range(STEPS):
        near = stats.join(now, "pool").withColumn("bin", bin_of(distance(values, F.col("estimate"))))
        now = kept(_nearest_share(near.groupBy(*keys, "bin").agg(*_moments(values)), keys).mapInPandas(_concentrated(H), _ESTIMATE), "mcd")
    least = now.groupBy("pool").agg(F.min_by(F.struct("start", "estimate"), F.struct("determinant", "start")).alias("best")).select("pool", "best.*")
    near = stats.join(least, "pool").filter(distance(values, F.col("estimate")) <= quantile(REWEIGHTED, P))
    return kept(near.groupBy(*keys).agg(*_moments(values)).mapInPandas(_concentrated(REWEIGHTED), _ESTIMATE), "mcd")


NULL = "\x1e"


def _judged(docs: DataFrame, of: DataFrame, estimate: DataFrame, made: str) -> tuple[DataFrame, Column, Column, Column]:
    """docs with their pool's estimate; base_failed, distance and kept of a row. The table of pairs is joined by its known size, or by AQE's split joins."""
    lang, source, found = (free_name(docs, x) for x in ("of_lang", "of_source", "of_pool"))
    pairs = of.join(estimate.select("pool", "estimate"), "pool", "left").select(F.coalesce("lang", F.lit(NULL)).alias(lang), F.coalesce("source", F.lit(NULL)).alias(source), F.col("estimate").alias(found))
    pairs = kept(pairs, "pairs")  # so that its size is known: a row for each pair, which is broadcast as long as that is small
    joined = docs.join(pairs, (F.coalesce(docs["lang"], F.lit(NULL)) == F.col(lang)) & (F.coalesce(docs["source"], F.lit(NULL)) == F.col(source)))
    n = F.col(made)
    failed = (n["n_words"] < 20) | (100 * n["n_repeat_words"] > 30 * n["n_words"])
    d2 = distance(list(vector(made).values()), F.col(found))
    return joined, failed, F.sqrt(d2), ~failed & F.coalesce(d2 <= CUT, F.lit(True))


def _fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    stats = kept(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    of = kept(pools(stats), "pools")
    named = of.select(F.coalesce("lang", F.lit(NULL)).alias("lang_"), F.coalesce("source", F.lit(NULL)).alias("source_"), "pool")
    keyed = stats.join(named, (F.coalesce("lang", F.lit(NULL)) == F.col("lang_")) & (F.coalesce("source", F.lit(NULL)) == F.col("source_")))
    return stats, of, estimates(keyed.select("pool", *[c.alias(n) for n, c in vector().items()]))


def verdicts(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text, lang, source): the counts, base_failed, distance, kept."""
    stats, of, estimate = _fitted(docs)
    joined, failed, far, stays = _judged(stats, of, estimate, "made")
    return joined.select("doc_id", *[F.col("made")[c].alias(c) for c in COUNTS if c != "n_lines"], failed.alias("base_failed"), stays.alias("kept"), far.alias("distance"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs. The texts stay where they are: they are counted again rather than shuffled."""
    _, of, estimate = _fitted(docs)
    made = free_name(docs)
    joined, _, _, stays = _judged(with_counts(docs, docs.columns, made), of, estimate, made)
    return joined.filter(stays).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
