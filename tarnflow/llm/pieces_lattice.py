"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into words that no piece crosses. The distinct words that a task has not met make a lattice: their
substrings of bounded length are exploded, equi-joined to the piece table (by hash, then by the characters), and the
edges are grouped by word and folded. A unigram model's fold is Viterbi: the best score to each place of a word. A BPE
model's pieces don't follow from a sum of scores, so Viterbi can't give its results; there the fold merges, in each
word, the best edge that spans exactly two symbols, until none does. Both run over all words of the lattice at once, and
the ids of a word are kept for its next occurrence. Characters without a piece are their UTF-8 bytes' pieces, or unk.

`lattice_native` is the same lattice with Spark's joins and higher-order functions; see README for why the query over
whole texts doesn't take it. Words of over LONG characters are merged through a heap instead, as the fold is quadratic.

Null and empty texts have no ids. Null or repeated doc_ids are rows like any others, an empty table gives none, other
columns are not read. U+2581 in a text is a space to the model, so such a text decodes to one with spaces.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, pieces, table

SPACE = "▁"
WORDS = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
LONG = 256
#: The longest word whose symbols fit in the bits of a long.
MASKED = 61
REMEMBERED = 900_000
SIEVE = 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table of a model file, and encoders of words."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(n)]
        self.unk = m.unk_id()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(n)]
        self.normal = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.scores = np.array([m.get_score(i) for i in range(n)])
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.special = {i for i in range(n) if m.is_control(i)}
        self.bpe = _is_bpe(path)
        self.most = max(map(len, self.normal))
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.normal)
        self.codes = np.zeros((n, self.most), dtype=np.uint32)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sieves: dict[int, np.ndarray] = {}  # by the top bits of a hash, whether a piece of the length may have it
        by: dict[int, list[int]] = {}
        for p, i in self.normal.items():
            self.codes[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), dtype="<u4")
            by.setdefault(len(p), []).append(i)
        for k, ids in by.items():
            h = np.zeros(len(ids), dtype=np.uint64)
            for j in range(k):
                h = (h ^ self.codes[ids, j]) * _MIX
            order = np.argsort(h)
            self.by_length[k] = h[order], np.array(ids)[order]
            self.sieves[k] = np.zeros(1 << SIEVE, bool)
            self.sieves[k][h >> np.uint64(64 - SIEVE)] = True

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, piece of every piece within the words that codes holds; ends[i] is where the word of place i ends."""
        found = []
        places, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for k in range(1, self.most + 1):
            if k > 1:
                inside = ends[places] >= places + k
                places, h = places[inside], h[inside]
            if not len(places):
                break
            h = (h ^ codes[places + (k - 1)]) * _MIX
            if k not in self.by_length:
                continue
            keys, ids = self.by_length[k]
            sieved = np.flatnonzero(self.sieves[k][h >> np.uint64(64 - SIEVE)])
            row = np.minimum(np.searchsorted(keys, h[sieved]), len(keys) - 1)
            hit = keys[row] == h[sieved]
            at, piece = places[sieved[hit]], ids[row[hit]]
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= self.codes[piece, j] == codes[at + j]
            found.append((at[same], at[same] + k, piece[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (spaces as SPACE), packed as little-endian unsigned 32-bit integers."""
        short = [i for i, w in enumerate(words) if w and (len(w) <= LONG or not self.bpe)]
        out = [b""] * len(words)
        for i, w in enumerate(words):
            if w and len(w) > LONG and self.bpe:
                ids = [x for s in merged_by_heap(w, self.normal, self.scores) for x in self._ids(s)]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        if short:
            text = "".join(words[i] for i in short)
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            sizes = np.array([len(words[i]) for i in short])
            word, stop = np.repeat(np.arange(len(short)), sizes), np.cumsum(sizes)
            start, end, piece = self.edges(codes, stop[word])
            cuts = self._merge(word, start, end, piece, stop, len(codes)) if self.bpe else self._viterbi(start, end, piece, stop - sizes, stop)
            self._pack(text, cuts, word, short, out, start * (self.most + 1) + end - start, piece)
        return out

    def _pack(self, text: str, cuts: np.ndarray, word: np.ndarray, short: list[int], out: list[bytes], spans: np.ndarray, piece: np.ndarray) -> None:
        """cuts: starts of symbols in text, in order; spans and piece: the edges, as start * (most + 1) + length."""
        ends = np.append(cuts[1:], len(text))
        order = np.argsort(spans)
        spans, piece = spans[order], piece[order]
        size = ends - cuts
        wanted = np.where(size <= self.most, cuts * (self.most + 1) + size, -1)
        row = np.minimum(np.searchsorted(spans, wanted), max(0, len(spans) - 1))
        known = spans[row] == wanted if len(spans) else np.zeros(len(cuts), bool)
        ids = np.where(known, piece[row], 0).astype("<u4").tobytes() if len(spans) else b""
        owner = word[cuts]
        bounds = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
        odd = set(owner[~known].tolist())
        for w, (i, a, b) in enumerate(zip(short, bounds, bounds[1:], strict=False)):
            if w not in odd:
                out[i] = ids[4 * a : 4 * b]
                continue
            mine = [x for c, e in zip(cuts[a:b].tolist(), ends[a:b].tolist(), strict=True) for x in self._ids(text[c:e])]
            out[i] = struct.pack(f"<{len(mine)}I", *mine)

    def _ids(self, symbol: str) -> list[int]:
        i = self.normal.get(symbol)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unk]

    def _merge(self, word: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
        """Places where symbols start once no two neighbours make a piece."""
        wide = end - start > 1
        start, end, piece = start[wide], end[wide], piece[wide]
        order = np.lexsort((start, -self.scores[piece], word[start]))  # by word, best first
        start, end = start[order], end[order]
        mine = word[start]
        following, alive = np.arange(1, n + 2), np.ones(n + 1, bool)  # a symbol's end is where the next one starts
        while len(start):
            middle = following[start]
            fits = alive[start] & (middle < end) & (following[np.minimum(middle, n)] == end)
            at = np.flatnonzero(fits)
            if not len(at):
                break
            at = at[np.unique(mine[at], return_index=True)[1]]  # the first of each word is the best
            alive[following[start[at]]] = False
            following[start[at]] = end[at]
            # An edge stays possible only while both its ends are starts of symbols, and words without a merge are done.
            busy = np.zeros(len(stop), bool)
            busy[mine[at]] = True
            left = busy[mine] & alive[start] & (alive[np.minimum(end, n)] | (end == n)) & (following[start] < end)
            start, end, mine = start[left], end[left], mine[left]
        return np.flatnonzero(alive[:n])

    def _viterbi(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places where the symbols of the best path start. A character without a piece is an edge of a score below all."""
        n = int(stop[-1])
        low = float(self.scores[list(self.normal.values())].min()) - 10
        single = np.zeros(n, bool)
        single[start[end - start == 1]] = True
        bare = np.flatnonzero(~single)
        start, end = np.concatenate([start, bare]), np.concatenate([end, bare + 1])
        score = np.concatenate([self.scores[piece], np.full(len(bare), low)])
        depth = end - np.repeat(begin, stop - begin)[start]  # ends are settled in the order of their distance from the word's begin
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, dtype=np.int64)
        order = np.lexsort((start, end, depth))
        start, end, score, depth = start[order], end[order], score[order], depth[order]
        first = np.zeros(n, bool)
        first[begin] = True
        for d in np.unique(depth):
            at = slice(*np.searchsorted(depth, [d, d + 1]))
            s, e = start[at], end[at]
            path = np.where(first[s], 0.0, best[s]) + score[at]
            top = np.lexsort((s, -path, e))
            ends, keep = np.unique(e[top], return_index=True)
            best[ends], back[ends] = path[top][keep], s[top][keep]
        cuts = []
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            while b > a:
                b = int(back[b])
                cuts.append(b)
        return np.sort(np.array(cuts, dtype=np.int64))

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        of_byte = {i: b for b, i in self.bytes.items()}
        for i in ids:
            if i in of_byte:
                held.append(of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.special:
                out.append(" ⁇ " if i == self.unk else self.names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _is_bpe(path: str) -> bool:
    """The model type in the file's trainer settings: field 2 of the model, field 3 within (1: unigram, 2: BPE)."""
    data = open(path, "rb").read()

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            x = shift = 0
            while True:
                b = data[at]
                at += 1
                x |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return x

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                n = number()
                yield key >> 3, data[at : at + n]
                at += n
            else:
                at += 8 if key & 7 == 1 else 4

    return any(k == 2 and isinstance(v, bytes) and (3, 2) in [(a, b) for a, b in fields(v) if isinstance(b, int)] for k, v in fields(data))


def merged_by_heap(word: str, normal: dict[str, int], scores: np.ndarray) -> list[str]:
    """Symbols of one long word, by the same merges."""
    n = len(word)
    left, right, symbol = list(range(-1, n - 1)), [*range(1, n), -1], list(word)
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (piece := normal.get(symbol[i] + symbol[j])) is not None:
            heapq.heappush(heap, (-float(scores[piece]), i, j, symbol[i] + symbol[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if symbol[i] is None or right[i] != j or symbol[i] + symbol[j] != both:
            continue
        symbol[i], symbol[j] = both, None
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s for s in symbol if s is not None]


class Encoder:
    """Ids of texts, with a bounded memory of words."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), {}

    def words(self, text: str) -> list[str]:
        text = " " + text.replace(SPACE, " ")
        return WORDS.findall(text) if self.pieces.splits else [text]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.words(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for ws in parts for w in ws if w not in self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {}
            fresh = list(dict.fromkeys(w for ws in parts for w in ws))
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            self.known.update(zip(some, self.pieces.encode_words([w.replace(" ", SPACE) for w in some]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id and ids (array) of each of docs (doc_id, text); with digest n_pieces, ids_crc32 and whether the ids decode to the text instead."""
    model = model or default_model()
    arrow_rows(docs.sparkSession)
    schema = [docs.schema["doc_id"]] + ([T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decodes", T.BooleanType())] if digest else [T.StructField("ids", T.ArrayType(T.LongType()))])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = batch.column(1).to_pylist()
                packed = e.encode(texts)
                if digest:
                    same = [e.pieces.decode(np.frombuffer(x, "<u4").tolist()) == (t or "") for x, t in zip(packed, texts, strict=True)]
                    columns = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(same, pa.bool_())]
                else:
                    columns = [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in packed], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(each, T.StructType(schema))


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids are an empty text."""
    model = model or default_model()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(each, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def piece_table(spark: SparkSession, model: str | None = None) -> DataFrame:
    """piece, id, score of the model's normal pieces; as many rows as the vocabulary."""
    p = Pieces(model or default_model())
    return spark.createDataFrame([(w, i, float(p.scores[i])) for w, i in p.normal.items()], "piece string, id int, score double")


def lattice_native(words: DataFrame, vocabulary: DataFrame, most: int = 16, bpe: bool = False) -> DataFrame:
    """word, symbols of distinct words (word, spaces as SPACE), in Spark alone: substrings are exploded, joined to the broadcast
    piece table (bounded by the vocabulary), grouped by word and folded in an aggregate: by Viterbi over the places for a
    unigram vocabulary, by merges for a BPE one. words are partitioned once, by word. A character without a piece has a score
    below all, or is a symbol that never merges. With bpe, words of over MASKED characters are left out, as a long's bits are
    the starts of their symbols."""
    words = words.select("word").distinct()
    n = F.length("word")
    if bpe:
        words = words.filter((n <= MASKED) & (n > 0))
    spans = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("s")).select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), n - F.col("s") + 1))).alias("k"))
    spans = spans.withColumn("piece", F.substring("word", F.col("s"), F.col("k")))
    edges = spans.join(F.broadcast(vocabulary), "piece", "left").filter(F.col("id").isNotNull() | (F.col("k") == 1))
    out = _merged(edges) if bpe else _best_paths(edges)
    ends = F.concat(F.slice("starts", 2, 1_000_000), F.array(F.length("word") + 1))
    return out.select("word", F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x: F.substring("word", x["a"], x["b"] - x["a"])).alias("symbols"))


def _best_paths(edges: DataFrame) -> DataFrame:
    edges = edges.select("word", F.struct((F.col("s") + F.col("k") - 1).alias("e"), "s", F.coalesce("score", F.lit(-1e6)).alias("score")).alias("edge"))
    by_word = edges.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    # best[i]: score and symbols of the best path that ends after i characters. Edges come in the order of their ends.
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("starts")))

    def step(acc, x):
        path = F.struct((F.element_at(acc, x["s"])["score"] + x["score"]).alias("score"), F.concat(F.element_at(acc, x["s"])["starts"], F.array(x["s"])).alias("starts"))
        last = F.element_at(acc, -1)
        new = F.size(acc) == x["e"]
        better = ~new & (path["score"] > last["score"])
        return F.when(new, F.concat(acc, F.array(path))).when(better, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(path))).otherwise(acc)

    return by_word.select("word", F.element_at(F.aggregate("edges", start, step), -1)["starts"].alias("starts"))


def _merged(edges: DataFrame) -> DataFrame:
    """Bit i of a word's state: a symbol starts after i characters, or the word ends. Each step merges the best edge that spans two symbols."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    low, high = bit(F.col("s") - 1), bit(F.col("s") + F.col("k") - 1)
    inner = F.when(F.col("k") > 1, high - 2 * low).otherwise(F.lit(0).cast("long"))  # the bits between
    edge = F.struct((-F.col("score")).alias("rank"), "s", low.bitwiseOR(high).alias("ends"), inner.alias("inner"))
    by_word = edges.groupBy("word").agg(F.array_sort(F.filter(F.collect_list(edge), lambda x: x["inner"] != 0)).alias("edges"))

    def step(state, _):
        fits = F.filter("edges", lambda x: (state.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(state.bitwiseAND(x["inner"])) == 1))
        return state.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inner"], F.lit(0).cast("long"))))

    places = F.sequence(F.lit(1), F.length("word"))
    state = F.aggregate(places, bit(F.length("word") + 1) - 1, step)
    folded = by_word.select("word", state.alias("state"))
    return folded.select("word", F.filter(places, lambda i: F.col("state").bitwiseAND(bit(i - 1)) != 0).alias("starts"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
