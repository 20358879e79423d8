"""Binary token files: independent zstandard frames, a document index and a trailing seek table with checksums.

Layout of a file: frames of token ids; one frame with the index of documents; a
skippable frame with the seek table in the public seekable zstandard format
(compressed size, size and XXH64 checksum of every frame). A reader fetches the
tail, then only the frames in which the wanted documents lie.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxframe.llm.encode import worker_encoder
from fluxframe.llm.text import batches, staged
from fluxframe.session import shared_folder

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER, ENTRY = "<IBI", "<III"

FRAME_IDS = 1 << 16
FILE_BYTES = 64 << 20


class TokenFileWriter:
    """Appends documents to an output stream. ``id_bytes`` is 2 or 4."""

    def __init__(self, out, id_bytes: int = 4, frame_ids: int = FRAME_IDS):
        self.out, self.kind, self.frame_ids = out, np.dtype(f"<u{id_bytes}"), frame_ids
        self.frames, self.doc_ids, self.lengths = [], [], []
        self.held, self.size, self.bytes = [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        at = 0
        while at < len(ids):
            part = ids[at : at + self.frame_ids - self.size]
            self.held.append(part.astype(self.kind))
            self.size, at = self.size + len(part), at + len(part)
            if self.size == self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            self._frame(np.concatenate(self.held).tobytes())
            self.held, self.size = [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.bytes += len(packed)

    def close(self) -> None:
        self._flush()
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        index = np.array([d or 0 for d in self.doc_ids], dtype="<i8"), np.array(self.lengths, dtype="<i8")
        self._frame(struct.pack("<QII", len(known), self.kind.itemsize, self.frame_ids) + index[0].tobytes() + index[1].tobytes() + known.tobytes())
        table = b"".join(struct.pack(ENTRY, *f) for f in self.frames) + struct.pack(FOOTER, len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class TokenFile:
    """Random access by document; decompresses a frame only when a wanted document lies in it."""

    def __init__(self, source):
        self.source = source
        size, tail, row = source.size(), struct.calcsize(FOOTER), struct.calcsize(ENTRY)
        count, flag, magic = struct.unpack(FOOTER, self._at(size - tail, tail))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = self._at(size - tail - count * row, count * row)
        self.frames = list(struct.iter_unpack(ENTRY, table))
        self.places = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])])
        if int(self.places[-1]) + 8 + len(table) + tail != size:
            raise ValueError("seek table does not fit the file")
        self.decompressor = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")
        raw = self.frame(count - 1)
        n, id_bytes, self.frame_ids = struct.unpack_from("<QII", raw)
        self.kind = np.dtype(f"<u{id_bytes}")
        ids, self.lengths = (np.frombuffer(raw, "<i8", n, 16 + 8 * n * k) for k in (0, 1))
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, raw[16 + 16 * n :])]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, size, check = self.frames[k]
            raw = self.decompressor.decompress(self._at(self.places[k], packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        parts = []
        for k in range(a // self.frame_ids, -(-b // self.frame_ids)):
            at = k * self.frame_ids
            parts.append(np.frombuffer(self.frame(k), self.kind)[max(a - at, 0) : b - at])
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order; returns the list of files: part, number, path, docs, tokens.

    The order holds within a file and over the list (part, number); NULL ids come
    first, rows of one id in any order. Ranges of ids are cut by Spark's range
    exchange, with a row number behind the id so that even one id with a third of
    all rows is divided. Every attempt of a task writes files of its own, and only
    the files of successful attempts are in the returned list, which is itself a
    written table: losing executors leaves at most unlisted files. ``folder`` is
    one all executors share, by default inside the checkpoint folder. Ids take two
    bytes where the vocabulary allows it.
    """
    spark = docs.sparkSession
    root = folder or f"{shared_folder(spark)}/tokens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        encoder = worker_encoder(tokenizer)
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        writer = path = None

        def listed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "docs": len(writer.doc_ids), "tokens": int(sum(writer.lengths))}], FILES)

        for b in batches(source):
            ids, at = encoder.encode_closed(b.column("text").to_pylist(), end_id)
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                if writer is None:
                    path = f"{base}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.tokens.zst"
                    writer = TokenFileWriter(store.open_output_stream(path, compression=None), id_bytes)
                writer.add(doc_id, ids[at[i] : at[i + 1]])
                if writer.bytes >= file_bytes:
                    yield listed()
                    writer, number = None, number + 1
        if writer is not None:
            yield listed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange(F.col("doc_id").asc(), F.col("row").asc()).sortWithinPartitions(F.col("doc_id").asc(), F.col("row").asc())
    return staged(placed.mapInArrow(run, "part int, number int, path string, docs bigint, tokens bigint"))


FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """All documents of the listed files: doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    ``folder`` names the file system, as it was given to the writer. The running
    total is over files, not documents. A damaged frame is an error.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in source:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                with store.open_input_file(path) as f:
                    file = TokenFile(f)
                    at = 0
                    while at < len(file.doc_ids):
                        to = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + (1 << 20), side="right")) - 1)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(file.doc_ids[at:to], pa.int64()), pa.array(before + file.starts[at:to]), pa.array(file.lengths[at:to]),
                            pa.array([file.document(i).astype("<u4").tobytes() for i in range(at, to)], pa.binary()),
                        ], ["doc_id", "start", "n_tokens", "ids"])
                        at = to

    behind = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("path", F.coalesce(F.sum("tokens").over(behind), F.lit(0)).alias("before"))
    # A number of tasks of its own: the list is tiny, and Spark would make one task of it.
    n, cores = files.count(), files.sparkSession.sparkContext.defaultParallelism
    return listed.repartitionByRange(max(1, min(n, max(cores, n // 4))), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
