"""Token-ID files: Simple-8b word-aligned coding with escapes and per-block offsets.

`write` encodes texts in ascending doc_id order into files of one format, one for each range of doc_ids, in the shared
folder; `read` gives a row for each document from them. Nothing but the files' table (a row for each file) comes to the
driver. A file is a magic number and segments of up to SEGMENT ids; a segment has its own table of documents, block
offsets, words and escapes, so that reader and writer hold one segment at a time, and a document may go on in the next.

Null and empty texts have the end id alone. A null doc_id sorts first and stays null, whatever its number in the file says;
equal doc_ids are written one after the other, each with its own row, and may spread over several files. An empty table gives no rows. Other columns are not read. Whole texts of any
length: a long document is spread over segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import arrow_rows, new_folder, table
from .tokens import default_vocabulary, text_ids

MAGIC = b"TFIDS8B2"
SEGMENT = 1 << 19
_HEAD = struct.Struct("<IIQQI")  # documents, blocks, ids, words, escapes
#: Flags of a document in a segment: its last part, and no doc_id.
_LAST, _NULL = 1, 2


def open_store(uri: str):
    """(file system, path) of a URI of any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class SegmentWriter:
    """Writes (doc_id, packed ids) to a file-like object."""

    def __init__(self, out):
        self.out, self.docs, self.parts, self.size = out, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        at = 0
        while True:
            room = (SEGMENT - self.size) * 4
            part = ids[at : at + room]
            at += len(part)
            last = at >= len(ids)
            self.docs.append((doc_id or 0, len(part) // 4, last * _LAST | (doc_id is None) * _NULL))
            self.parts.append(part)
            self.size += len(part) // 4
            if self.size >= SEGMENT:
                self.flush()
            if last:
                return

    def flush(self) -> None:
        if not self.docs:
            return
        values = np.frombuffer(b"".join(self.parts), dtype="<u4")
        words, offsets, escapes = simple8b.encode(values)
        self.out.write(_HEAD.pack(len(self.docs), len(offsets) - 1, len(values), len(words), len(escapes)))
        for column, kind in zip(zip(*self.docs, strict=True), ("<i8", "<u4", "<u1"), strict=True):
            self.out.write(np.array(column, dtype=kind).tobytes())
        for x, kind in ((offsets, "<u4"), (words, "<u8"), (escapes, "<u8")):
            self.out.write(x.astype(kind).tobytes())
        self.docs, self.parts, self.size = [], [], 0


def read_documents(file) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, first id's place in the file, ids, crc32) of each document of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-ID file")
    place, count, crc = 0, 0, 0
    while head := file.read(_HEAD.size):
        n_docs, n_blocks, n_ids, n_words, n_escapes = _HEAD.unpack(head)
        take = lambda kind, n: np.frombuffer(file.read(np.dtype(kind).itemsize * n), dtype=kind)
        doc_ids, lengths, flags = take("<i8", n_docs), take("<u4", n_docs), take("<u1", n_docs)
        offsets, words, escapes = take("<u4", n_blocks + 1), take("<u8", n_words), take("<u8", n_escapes)
        ids = memoryview(simple8b.decode(words, offsets, escapes, n_ids).astype("<u4").tobytes())
        at = 0
        for doc_id, n, flag in zip(doc_ids.tolist(), lengths.tolist(), flags.tolist(), strict=True):
            crc = zlib.crc32(ids[at * 4 : (at + n) * 4], crc)
            at, count = at + n, count + n
            if flag & _LAST:
                yield None if flag & _NULL else doc_id, place, count, crc
                place, count, crc = place + count, 0, 0


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> list[tuple[str, int]]:
    """Writes the files; (path, ids) of each, in ascending order of their doc_ids. A task that runs again writes the same file."""
    arrow_rows(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = text_ids(vocabulary).encode, TaskContext.get()
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        final, n = f"{top}/ids-{context.partitionId():06d}.s8b", 0
        draft = f"{final}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(draft) as out:
            writer = SegmentWriter(out)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    writer.add(doc_id, ids)
                    n += len(ids) // 4
            writer.flush()
        if n:
            store.move(draft, final)
        else:
            store.delete_file(draft)
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [final], "n_ids": [n]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())]))

    # Ranges of doc_id and row, so that the rows of a null or repeated doc_id don't all end in one task.
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = ordered.mapInArrow(each, "part int, path string, n_ids long").collect()
    return [(r["path"], r["n_ids"]) for r in sorted(rows, key=lambda r: r["part"]) if r["n_ids"]]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    base, listed = 0, []
    for path, n in files:
        listed.append((path, base))
        base += n

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        store, _ = open_store(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with store.open_input_stream(path) as file:
                    for doc_id, place, n, crc in read_documents(file):
                        rows.append((doc_id, base + place, n, crc))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    table = spark.createDataFrame(listed, "path string, base long").repartition(max(1, len(listed)))
    return table.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids and reads them back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    return read(spark, folder, write(docs, folder, vocabulary or default_vocabulary(), end_id))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_file": op6_token_file}
