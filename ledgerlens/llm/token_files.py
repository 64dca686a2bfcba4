"""Token ids as binary files: Simple-8b word-aligned coding, in ascending order of documents.

Documents are cut into ranges of ids, one task each. A task encodes its texts in order and writes
segments of about ``SEGMENT_IDS`` ids, each a file of its own; a document is never split. A segment
holds, little-endian:

    magic (8 bytes), shard, segment (u32), documents, ids, blocks, words, escapes, id bytes (u64)
    start of each document among the segment's ids and their end (u64, documents + 1)
    length of each document's id as text, 0xFFFFFFFF for null (u32), then those texts (UTF-8)
    words and escapes of each block (u32 each), then the words (u64), then the escapes (u64)
    CRC-32 of all that precedes (u32)

The offsets of blocks are sums of their counts, so any stretch of ids is decoded from its blocks alone.
Shards follow the order of ranges and segments the order within them: the start of a document among
all ids is the sum of the segments before its own, from their headers, and its start in its segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, opened, text_or_empty
from ledgerlens.llm.simple8b import BLOCK, Packed, pack, unpack
from ledgerlens.llm.word_ids import WordEncoder
from ledgerlens.sources.scratch import new_folder
from ledgerlens.sources.tables import table

SEGMENT_IDS = 4_000_000
SLICE_TEXTS = 256
PACKED_AT_ONCE = 1024 * BLOCK
END_ID = 1

_MAGIC = b"LLIDS8B1"
_HEAD = "<8sIIQQQQQQ"
_NULL = 0xFFFFFFFF

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Segment:
    """A segment in the making: ids are packed as soon as there are enough of them for many blocks."""

    def __init__(self):
        self.names: list[str | None] = []
        self.starts, self.n = [0], 0
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.done: list[Packed] = []

    def add(self, name: str | None, ids: bytes) -> None:
        self.names.append(name)
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)
        self.n += len(ids) // 4
        self.starts.append(self.n)
        if self.waiting_bytes >= 4 * PACKED_AT_ONCE:
            self._pack(last=False)

    def _pack(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        self.done += [pack(ids[i : min(whole, i + PACKED_AT_ONCE)]) for i in range(0, whole, PACKED_AT_ONCE)]
        self.waiting, self.waiting_bytes = [ids[whole:].tobytes()], 4 * (len(ids) - whole)

    def data(self, shard: int, number: int) -> bytes:
        self._pack(last=True)
        words, escapes, block_words, block_escapes = (np.concatenate([p[i] for p in self.done] or [np.empty(0)]) for i in range(4))
        names = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in self.names]
        lengths = np.array([_NULL if x is None else len(b) for x, b in zip(self.names, names, strict=True)], "<u4")
        blob = b"".join(names)
        head = struct.pack(_HEAD, _MAGIC, shard, number, len(names), self.n, len(block_words), len(words), len(escapes), len(blob))
        body = b"".join([head, np.array(self.starts, "<u8").tobytes(), lengths.tobytes(), blob, block_words.astype("<u4").tobytes(), block_escapes.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])
        return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """A segment that was read: its documents, and any stretch of its ids."""

    def __init__(self, data: bytes):
        magic, self.shard, self.number, docs, self.n, blocks, n_words, n_escapes, n_blob = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("not a whole segment of token ids")
        at = struct.calcsize(_HEAD)

        def taken(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.starts, lengths = taken("<u8", docs + 1).astype(np.int64), taken("<u4", docs)
        blob = taken("u1", n_blob).tobytes()
        ends = np.cumsum(np.where(lengths == _NULL, 0, lengths), dtype=np.int64)
        self.names = [None if n == _NULL else blob[b - n : b].decode("utf-8", "surrogatepass") for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
        self.block_words, self.block_escapes = taken("<u4", blocks), taken("<u4", blocks)
        self.words, self.escapes = taken("<u8", n_words), taken("<u8", n_escapes)
        self.word_at, self.escape_at = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.block_words, self.block_escapes))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, decoded from the blocks that hold them."""
        a, b = start // BLOCK, min(-(-stop // BLOCK), len(self.block_words))
        packed = Packed(self.words[self.word_at[a] : self.word_at[b]], self.escapes[self.escape_at[a] : self.escape_at[b]], self.block_words[a:b], self.block_escapes[a:b])
        return unpack(packed, min(b * BLOCK, self.n) - a * BLOCK)[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[str | None, int, np.ndarray]]:
        """Each document's id as text, its start in the segment and its ids, some blocks at a time."""
        first = 0
        while first < len(self.names):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + PACKED_AT_ONCE, side="right")) - 1)
            some = self.ids(int(self.starts[first]), int(self.starts[last]))
            for i in range(first, last):
                yield self.names[i], int(self.starts[i]), some[self.starts[i] - self.starts[first] : self.starts[i + 1] - self.starts[first]]
            first = last


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text and write the segments into folder; returns one row per file: path, shard,
    segment, documents, ids.

    Rows go to tasks by ranges of (doc_id, hash of the text, row), so no id with many rows is one
    task's burden and rows of one id are in one order in every run; null ids come last. Files are
    written under another name and moved, so a task that is run again leaves whole files only."""
    rows = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    order = [F.col("none"), F.col("doc_id"), F.col("print"), F.col("row")]
    rows = rows.select(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("print"), F.monotonically_increasing_id().alias("row"), "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard, number, segment = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, _Segment()
        store, base = opened(folder)
        end = struct.pack("<I", end_id)

        def put() -> pa.RecordBatch:
            nonlocal number, segment
            name = f"part-{shard:06d}-{number:06d}.s8b"
            store.create_dir(base, recursive=True)
            own = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own, compression=None) as out:
                out.write(segment.data(shard, number))
            store.move(own, f"{base}/{name}")
            row = {"path": [f"{folder}/{name}"], "shard": [shard], "segment": [number], "documents": [len(segment.names)], "ids": [segment.n]}
            number, segment = number + 1, _Segment()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("shard", pa.int64()), ("segment", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            for i in range(0, len(batch), SLICE_TEXTS):
                part = batch.slice(i, SLICE_TEXTS)
                for name, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    segment.add(name, ids + end)
                    if segment.n >= segment_ids:
                        yield put()
        if segment.n:
            yield put()

    return materialize(rows.mapInArrow(write, "path string, shard long, segment long, documents long, ids long"), "token-files")


def _placed(files: DataFrame) -> DataFrame:
    """path and base: the number of ids in all segments before, from the files' headers. Sums run
    within a shard, and over the shards' totals, of which there is one per writing task."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                store, path = opened(uri)
                with store.open_input_stream(path, compression=None) as f:
                    _, shard, number, _, n, *_ = struct.unpack(_HEAD, f.read(struct.calcsize(_HEAD)))
                rows.append((uri, shard, number, n))
            paths, *numbers = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], names=["path", "shard", "segment", "ids"])

    found = materialize(files.select("path").mapInArrow(heads, "path string, shard long, segment long, ids long"), "token-heads")
    shards = found.groupBy("shard").agg(F.sum("ids").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("earlier"))
    own = found.withColumn("here", F.sum("ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("ids"))
    return own.join(before, "shard").select("path", (F.col("earlier") + F.col("here")).alias("base"))


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id (string), start, n_tokens, ids_crc32, and the ids
    where wanted. Each task opens whole segments and decodes them some blocks at a time."""
    n = max(1, min(files.count(), 100_000))
    fields = [("doc_id", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, path = opened(uri)
                with store.open_input_stream(path, compression=None) as f:
                    segment = Segment(f.read())
                rows = []
                for name, start, ids in segment.documents():
                    rows.append((name, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return _placed(files).repartition(n).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, with_ids: bool = False) -> DataFrame:
    """Write the ids of docs (doc_id, text) and read them back. One row per document: doc_id, start,
    n_tokens, ids_crc32, and the ids where wanted.

    Null text counts as empty and has the end id alone. Documents stand in ascending order of doc_id,
    null ids last; rows of one id stand by the hash of their text, and rows that are equal in both may
    change places. An empty table writes no file and gives no rows; further columns are ignored. A task
    holds one Arrow batch, one segment (or one longer document) and the memos."""
    folder = folder or new_folder(docs.sparkSession, "token-ids")
    back = read_token_files(write_token_files(docs, tokenizer_path, folder, end_id, segment_ids), with_ids)
    kind = needed(docs, "doc_id").schema["doc_id"].dataType
    return back.withColumn("doc_id", F.col("doc_id").cast(kind))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
