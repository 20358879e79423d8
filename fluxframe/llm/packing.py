"""Hierarchical packing of documents into sequences of several lengths."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.encode import WORDS, worker_encoder
from fluxframe.llm.text import batches

TIERS = (256, 512, 1024, 2048)
#: Tokens in a step group.
STEP_TOKENS = 16_384
#: Text that is packed together.
GROUP_BYTES = 4 << 20

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens int, step_id bigint, ids binary"


class Packer:
    """Places documents, a group at a time; a piece is (document, start, length, sequence, offset, size of the sequence, step group).

    A document is routed to the smallest tier that holds it; whole windows of the
    longest tier are cut off first. The longest document left opens a sequence of
    its tier, gaps take the longest shorter documents that fit whole, and what no
    document fits is closed with the beginning of the shortest one left, whose
    rest is routed anew. So every sequence is full. Step groups hold sequences of
    one size and the same number of tokens each.
    """

    def __init__(self, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.sequences = self.steps = 0
        self.open_steps: dict[int, tuple[int, int]] = {}

    def _sequence(self, size: int) -> tuple[int, int]:
        number, self.sequences = self.sequences, self.sequences + 1
        step, left = self.open_steps.get(size, (0, 0))
        if left < size:
            step, left, self.steps = self.steps, max(size, self.step_tokens), self.steps + 1
        self.open_steps[size] = (step, left - size)
        return number, step

    def pack(self, lengths: Sequence[int]) -> list[tuple[int, int, int, int, int, int, int]]:
        out, longest, pool = [], self.tiers[-1], []
        for doc, n in enumerate(lengths):
            at = 0
            while n - at >= longest:
                number, step = self._sequence(longest)
                out.append((doc, at, longest, number, 0, longest, step))
                at += longest
            if n > at:
                pool.append((n - at, doc, at))
        pool.sort()
        while pool:
            n, doc, start = pool.pop()
            size = next(t for t in self.tiers if t >= n)
            held, gap = [(doc, start, n)], size - n
            while gap and pool:
                fits = bisect_right(pool, (gap, len(lengths), 0))
                if fits:
                    n, doc, start = pool.pop(fits - 1)
                    held.append((doc, start, n))
                    gap -= n
                else:
                    n, doc, start = pool.pop(0)
                    held.append((doc, start, gap))
                    insort(pool, (n - gap, doc, start + gap))
                    gap = 0
            self._place(held, size if not gap else 0, out)
        return out

    def _place(self, held: list[tuple[int, int, int]], size: int, out: list) -> None:
        """One full sequence; or what is left at the end, in sequences whose lengths are powers of two."""
        left = sum(n for *_, n in held)
        held = held[::-1]
        while left:
            room = size or min(self.tiers[-1], 1 << (left.bit_length() - 1))
            number, step = self._sequence(room)
            left, offset, total = left - room, 0, room
            while room:
                doc, start, n = held.pop()
                take = min(n, room)
                out.append((doc, start, take, number, offset, total, step))
                offset, room = offset + take, room - take
                if take < n:
                    held.append((doc, start + take, n - take))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS,
                   remember: int = WORDS) -> DataFrame:
    """Pieces of all documents (doc_id, text) in full sequences, with their token ids (little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a tokenizers file that executors can read. A
    document's tokens are its ids and ``end_id``; each lies in exactly one piece.
    Sequences are as long as their tier, or a power of two where a group of
    documents ends, so none needs padding. sequence_id and step_id are unique;
    offsets in a sequence have no gaps.

    Documents are encoded and packed where they are read, in groups of bounded
    text size: nothing is shuffled, and no source, id or length can be hot. The
    result depends on how the input is split, a rerun of a task repeats its part.
    A NULL text is empty and holds ``end_id`` alone. NULL ids and repeated rows
    are packed like others. Other columns are not read.

    A worker keeps the ids of ``remember`` words at most: fewer take less memory
    and more time, and change no result.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        encoder, packer = worker_encoder(tokenizer, remember), Packer(tiers, step_tokens)
        for b in _groups(source):
            doc_ids = b.column("doc_id").cast(pa.int64())
            # A group is packed as one, but encoded a little at a time.
            parts = [encoder.encode_closed(s.column("text").to_pylist(), end_id) for s in batches(iter([b]), most=1 << 19)]
            ids, at = np.concatenate([p for p, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
            doc, start, length, number, offset, size, step = np.array(packer.pack(np.diff(at).tolist()), dtype=np.int64).T
            raw, a = ids.astype("<u4", copy=False), at[doc] + start
            yield pa.RecordBatch.from_arrays([
                doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(np.diff(at)[doc]), pa.array(base + number), pa.array(offset),
                pa.array(size.astype(np.int32)), pa.array(base + step), pa.array([raw[i : i + n].tobytes() for i, n in zip(a, length)], pa.binary()),
            ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def _groups(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of about GROUP_BYTES of text (one row at least), joined over input batches."""
    held, size = [], 0
    for b in batches(source, most=GROUP_BYTES):
        held.append(b)
        size += b.nbytes
        if size >= GROUP_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
