"""Secret scans: three base patterns and a randomness test battery for other tokens.

Base spans (assign, access, hex) are leftmost non-overlapping matches of each kind in the whole text. The battery looks
at every run of token characters that meets no base span: it infers the encoding (hex, base32, alphanumeric, base64) from
the characters, and tests the characters' values for chi-squared uniformity over that alphabet, for runs above and below
the middle, and for serial correlation. The three p-values are combined by Fisher's method. Random strings have uniform
p-values; prose, paths and identifiers have p-values near zero, the more so the longer they are. So the control is by
length: in each encoding and band of lengths the corpus-wide histogram of p-values (pre-aggregated, a row for each bin)
is compared with its own mirror image: what lies left of 0.5 beyond a cut in excess of what lies as far right of it is no
random string. The least cut is taken for which this excess, plus one and half its standard deviation, is at most
FALSE_SHARE of all beyond the cut; the added one keeps the share in small counts, too. A band with fewer than ENOUGH
tokens right of 0.5 is pooled with its neighbours of the same encoding until there are as many. An encoding that has
fewer in all has the fixed cut ALONE_P, if half as many tokens at most lie below it as beyond, and no more (or ALONE at
most) left of 0.5 than right of it; or else 0.5. A band whose tokens are never told apart adds nothing.

Null and empty texts have no spans and the digest of the empty string. Null or repeated doc_ids are rows like any
others, an empty table gives none, and columns other than doc_id and text are not read. Offsets are code points, ends
exclusive; spans that start together are in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, kept, table, tidy

KINDS = ("assign", "access", "hex", "random")
# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer is dropped anyway
LEAST = {"assign": 12, "access": 18, "hex": 16}
_WORDS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Encodings, tried in this order; a token has the first whose alphabet holds all its characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
}
P_BINS, BANDS = 100, 64
FALSE_SHARE = 0.1
#: Tokens in the right half that a histogram needs for itself; the fixed cut's p-value, and the most tokens it may add where none are in the right half (all of so many are left of 0.5 once in 16 times).
ENOUGH, ALONE_P, ALONE = 12, 0.1, 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end)"""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # an ASCII letter has no other lower case
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def encoding_of(token: str) -> str:
    used = set(token)
    return next((name for name, letters in ENCODINGS.items() if used <= _SETS[name]), "mixed")


_SETS = {k: set(v) for k, v in ENCODINGS.items()}
_VALUES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution, by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """Fisher's combined p-value of the three tests; near zero if the token is no random string of its encoding."""
    body = token.rstrip("=") or token
    values, size, n = np.array([_VALUES[encoding].get(c, 0) for c in body]), len(ENCODINGS[encoding]), len(body)
    # Uniformity: few characters for a large alphabet, so it is folded to at most n / 5 classes of like size, by kind of character first.
    classes = max(2, min(size, n // 5))
    expected = np.bincount(np.arange(size) * classes // size, minlength=classes) * n / size
    seen = np.bincount(values * classes // size, minlength=classes)
    p = [chi2_tail(float(((seen - expected) ** 2 / expected).sum()), classes - 1)]
    high = values >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p.append(_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = values - values.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p.append(_tail((r + 1 / n) * math.sqrt(n)))
    stat = -2 * sum(math.log(max(x, 1e-300)) for x in p)
    half = stat / 2  # the tail of chi-squared with six degrees of freedom in closed form
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of tokens that meet no base span."""
    out, at = [], 0
    busy: list[list[int]] = []  # base spans, joined where they overlap
    for a, _, b in sorted(spans):
        if busy and a < busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], b)
        else:
            busy.append([a, b])
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if at < len(busy) and busy[at][0] < end:
            continue
        encoding = encoding_of(m[0])
        out.append((start, end, encoding, randomness(m[0], encoding)))
    return out


def band(length: int) -> int:
    """Bands widen with the length: four to an octave."""
    return min(BANDS - 1, int(4 * math.log2(length)))


_FOUND = T.StructType([
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("encoding", T.StringType()), T.StructField("band", T.LongType()), T.StructField("bin", T.LongType())]))),
])
_ARROW = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))),
    ("tokens", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("band", pa.int64()), ("bin", pa.int64())]))),
])


def _scan(text: str | None) -> dict:
    text = text or ""
    spans = base_spans(text)
    tokens = [{"start": a, "end": b, "encoding": e, "band": band(b - a), "bin": min(P_BINS - 1, int(p * P_BINS))} for a, b, e, p in candidates(text, spans)]
    return {"base": [{"start": a, "kind": k, "end": b} for a, k, b in spans], "tokens": tokens}


def scanned(docs: DataFrame, columns: list[str], name: str = "_found") -> DataFrame:
    """The columns of docs named, and what each text holds."""
    arrow_rows(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(name, _FOUND)])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = pa.array([_scan(t.as_py()) for t in texts], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + [found], names=[*columns, name])

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(tidy(each), schema)


def cuts(found: DataFrame) -> dict[str, int]:
    """'encoding:band' -> the least bin of accepted p-values. The histogram has at most encodings x bands x bins rows at any size of the corpus."""
    t = F.explode("_found.tokens").alias("t")
    rows = found.select(t).groupBy("t.encoding", "t.band", "t.bin").count().collect()
    seen: dict[str, np.ndarray] = {}
    for r in rows:
        seen.setdefault(f"{r['encoding']}:{r['band']}", np.zeros(P_BINS))[r["bin"]] += r["count"]
    return cuts_of(seen)


def cut_of(bins: np.ndarray) -> int | None:
    """The least bin with at most FALSE_SHARE of false tokens at or beyond it, by the histogram's mirror image."""
    half = P_BINS // 2
    right = bins[half:].sum()
    for low in range(1, half + 1):
        left, mirror = bins[low:half].sum(), bins[half : P_BINS - low].sum()
        if max(0.0, left - mirror) + 1 + 0.5 * math.sqrt(left + mirror) <= FALSE_SHARE * (right + left):
            return low
    return None


def cuts_of(seen: dict[str, np.ndarray]) -> dict[str, int]:
    out = {}
    half, alone = P_BINS // 2, int(ALONE_P * P_BINS)
    for key, bins in seen.items():
        encoding, at = key.rsplit(":", 1)
        pool, reach = bins, 0
        while pool[half:].sum() < ENOUGH and reach < BANDS:
            reach += 1
            pool = pool + sum(seen[k] for k in {f"{encoding}:{int(at) - reach}", f"{encoding}:{int(at) + reach}"} if k in seen)
        low, left, right = pool[:alone].sum(), pool[alone:half].sum(), pool[half:].sum()
        if right >= ENOUGH:
            cut = cut_of(pool)
        elif 2 * low <= left + right and left <= max(right, ALONE):
            cut = alone
        else:
            cut = half if right else None
        if cut is not None:
            out[key] = cut
    return out


_SPANS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of each of docs (doc_id, text)."""
    found = kept(scanned(docs, ["doc_id"]), "secrets")
    accepted = cuts(found)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(6)]
            for f in batch.column(1).to_pylist():
                base = [(s["start"], s["kind"], s["end"]) for s in f["base"]]
                more = _accepted(f["tokens"], accepted)
                row = *(sum(s[1] == k for s in base) for k in range(3)), len(more), hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + more))
                for column, x in zip(made, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in made[:4]), *(pa.array(c, pa.string()) for c in made[4:])], names=["doc_id", *(x.split()[0] for x in _SPANS.split(", "))])

    return found.mapInArrow(tidy(each), "doc_id " + dict(found.dtypes)["doc_id"] + ", " + _SPANS)


def _accepted(tokens: list[dict], accepted: dict[str, int]) -> list[tuple[int, int, int]]:
    return [(t["start"], 3, t["end"]) for t in tokens if t["bin"] >= accepted.get(f"{t['encoding']}:{t['band']}", P_BINS)]


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of the scan replaced in the text; overlapping spans become one mask. n_chars follows, if there is one. A null text stays null."""
    accepted = cuts(kept(scanned(docs, ["doc_id"]), "secrets"))
    columns = docs.columns

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if text:
                    f = _scan(text)
                    spans = sorted([(s["start"], s["end"]) for s in f["base"]] + [(a, b) for a, _, b in _accepted(f["tokens"], accepted)])
                    out, at = [], 0
                    for a, b in spans:
                        if a >= at:
                            out += [text[at:a], mask]
                        at = max(at, b)
                    text = "".join([*out, text[at:]])
                texts.append(text)
                sizes.append(None if text is None else len(text))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[batch.schema.get_field_index("text")] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                arrays[batch.schema.get_field_index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(tidy(each), docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
