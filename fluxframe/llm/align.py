"""Alignment of two tokenizers by interval coalescing.

Tokens of A (byte-level BPE) and B (SentencePiece) are byte ranges of the same
bytes. All ranges are sorted by start and their ends accumulated to a running
maximum; where a start reaches that maximum both tokenizers end a token, and a
group ends. Inside groups the overlapping ranges are expanded to links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxframe.llm.encode import SAFE
from fluxframe.llm.spm import MARKER, SentencePieceModel
from fluxframe.llm.text import batches, staged, worker_state

#: A single blank between two of these characters begins a new token of either kind.
_CUT = re.compile(f"(?<=[{SAFE}]) (?=[{SAFE}])")
_SAFE = {chr(c) for c in range(0x250) if re.match(f"[{SAFE}]", chr(c))}
#: Pieces that are encoded in one text.
TOGETHER = 400
#: Pieces that one task remembers before it forgets them all, and bytes of text aligned at a time. Neither decides a result.
REMEMBER, SLICE_BYTES = 300_000, 1 << 20
#: Links and distinct id pairs in that memory, likewise.
LINKS, PAIRS = 1 << 24, 1 << 21


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Group number of each range; ranges of a group are chained by overlaps, and no range reaches into another group."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(starts), dtype=np.int64)
    group[order] = np.concatenate([[0], np.cumsum(starts[order][1:] >= reach[:-1])]) if len(starts) else 0
    return group


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all tokens that share a byte, where either side's tokens cover the bytes without gaps."""
    a_starts, b_starts = (np.concatenate([[0], e])[:-1] for e in (a_ends, b_ends))
    first, behind = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left")
    n = behind - first
    at = np.repeat(np.arange(len(a_ends)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class Aligner:
    """Groups and links of texts. Distinct pieces between single blanks are aligned once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_of_letter()
        n = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        raw = open(b_path, "rb").read()
        model = SentencePieceModel.parse(raw)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cuts = model.cuts_at_blanks() and model.dummy_prefix
        # Ids as text behind each mark that can stand in front of them.
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.marked = [f"{mark}{i}" for mark in ("\n", ";", "|", ",") for i in range(self.width)]
        self._forget_pairs()

    def _forget_pairs(self) -> None:
        self.codes, self.numbers = np.zeros(1 << 16, dtype=np.int64), {}
        self._forget()

    def _forget(self) -> None:
        """Per piece: whether its bytes are right, tokens of A and B, groups, and where its links lie; links are numbers of id pairs."""
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.figures = np.zeros((1 << 12, 5), dtype=np.int64)
        self.first = np.zeros(1 << 12, dtype=np.int64)
        self.links, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def _encoded(self, units: list[list[str]]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and B for pieces joined by blanks, and whether they give the bytes back."""
        texts = [" ".join(u) for u in units]
        a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        raw = [b" " + t.encode("utf-8") for t in texts]
        return a, b, [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw)]

    def _learn(self, pieces: list[str]) -> None:
        # What may be cut at a blank may be joined by one: many pieces are encoded in one text, and told apart by their bytes.
        inner = [p for p in pieces if self.cuts and p[0] in _SAFE and p[-1] in _SAFE]
        joined = set(inner)
        units = [inner[i : i + TOGETHER] for i in range(0, len(inner), TOGETHER)] + [[p] for p in pieces if p not in joined]
        a, b, good = self._encoded(units)
        broken = [i for i, (u, g) in enumerate(zip(units, good)) if not g and len(u) > 1]
        if broken:
            alone = [[p] for i in broken for p in units[i]]
            units, a, b, good = ([x for i, x in enumerate(old) if i not in set(broken)] + new for old, new in zip((units, a, b, good), (alone, *self._encoded(alone))))
        pieces = list(chain.from_iterable(units))
        k, n = len(self.known), len(pieces)
        self.known.update(zip(pieces, range(k, k + n)))
        self.figures, self.first = _grown(self.figures, k + n), _grown(self.first, k + n)
        figures = np.zeros((n, 5), dtype=np.int64)
        figures[:, 0] = np.repeat(good, [len(u) for u in units])
        a, b = (np.fromiter(chain.from_iterable(x for x, g in zip(s, good) if g), dtype=np.int64) for s in (a, b))
        # Right pieces follow each other without gaps in one run of bytes, the same for both sides.
        behind = np.cumsum(figures[:, 0] * np.array([len(p.encode("utf-8")) + 1 for p in pieces], dtype=np.int64))
        ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        sides = np.repeat([0, 1], [len(a), len(b)])
        starts = np.concatenate([ends[0] - self.a_size[a], ends[1] - self.b_size[b]])
        group = coalesce(starts, np.concatenate(ends), sides)
        of = np.searchsorted(behind, starts, side="right")
        figures[:, 1], figures[:, 2] = np.bincount(of[: len(a)], minlength=n), np.bincount(of[len(a) :], minlength=n)
        order = np.lexsort((starts, sides, group))
        g, s, o, ids = group[order], sides[order], of[order], np.concatenate([a, b])[order]
        change = [np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=bool) for x in (o, g, s)]
        figures[:, 3] = np.bincount(o[change[1]], minlength=n)
        mark = np.select(change, [0, 1, 2], 3)
        written = iter("".join(map(self.marked.__getitem__, (mark * self.width + ids).tolist())).split("\n")[1:])
        self.text += [next(written) if f else "" for f in (figures[:, 1] > 0).tolist()]
        i, j = overlaps(*ends)
        code = (a[i] << 32) | b[j]
        distinct, back = np.unique(code, return_inverse=True)
        number = np.fromiter((self.numbers.setdefault(c, len(self.numbers)) for c in distinct.tolist()), dtype=np.int32, count=len(distinct))
        self.codes = _grown(self.codes, len(self.numbers))
        self.codes[number] = distinct
        figures[:, 4] = np.bincount(of[: len(a)][i], minlength=n)
        self.links = _grown(self.links, self.used + len(code))
        self.links[self.used : self.used + len(code)] = number[back]
        self.figures[k : k + n] = figures
        self.first[k : k + n] = self.used + np.cumsum(figures[:, 4]) - figures[:, 4]
        self.used += len(code)

    def slices(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
        """(documents, pieces of a stretch of each) with a bounded number of bytes where blanks allow it."""
        owners, held, size = [], [], 0
        for d, t in enumerate(texts):
            if not t:
                continue
            at = 0
            while at < len(t):
                to = len(t)
                if self.cuts and to - at > SLICE_BYTES:
                    cut = _CUT.search(t, at + SLICE_BYTES)
                    to = cut.start() if cut else to
                part = t[at:to]
                owners.append(d)
                held.append(_CUT.split(part) if self.cuts else [part])
                size += len(part)
                at = to + 1  # the blank at the cut stands in front of the next piece
                if size >= SLICE_BYTES:
                    yield np.array(owners), held
                    owners, held, size = [], [], 0
        if owners:
            yield np.array(owners), held

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text: tokens of A and B, groups, links, and the digest of its groups; and per text and id pair: (text << 32 | number), times."""
        if len(self.numbers) > PAIRS:
            self._forget_pairs()
        n = len(texts)
        figures, digests = np.zeros((n, 5), dtype=np.int64), [None] * n
        bad = np.zeros(n, dtype=bool)
        keys, times = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for owners, held in self.slices(texts):
            if len(self.known) > REMEMBER or self.used > LINKS:
                self._forget()
            new = list(dict.fromkeys(p for pieces in held for p in pieces if p not in self.known))
            if new:
                self._learn(new)
            where = list(map(self.known.__getitem__, chain.from_iterable(held)))
            k, count = np.array(where, dtype=np.int64), np.array([len(p) for p in held])
            of = np.repeat(owners, count)
            np.add.at(figures, of, self.figures[k])
            np.logical_or.at(bad, of, self.figures[k, 0] == 0)
            at = 0
            for d, c in zip(owners.tolist(), count.tolist()):
                if digests[d] is None:
                    digests[d] = hashlib.sha256()
                else:
                    digests[d].update(b";")
                digests[d].update(";".join([self.text[i] for i in where[at : at + c]]).encode())
                at += c
            m = self.figures[k, 4]
            links = self.links[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k], m)]
            key, t = np.unique((np.repeat(of, m) << 32) | links, return_counts=True)
            keys.append(key)
            times.append(t)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        t = np.zeros(len(key), dtype=np.int64)
        np.add.at(t, back, np.concatenate(times))
        right = ~bad[key >> 32]
        figures[bad] = 0
        return figures[:, 1:], ["" if bad[d] or digests[d] is None else digests[d].hexdigest() for d in range(n)], key[right], t[right]


def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, kept between tasks."""
    return worker_state(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _shut(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32, bytes of equal weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _opened(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=4 * n + 1), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


BLOCKS = (
    "block bigint, pairs array<bigint>, holders array<int>, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, sizes array<int>, steps binary, times binary"
)
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per slice of a few MB of text: its distinct id pairs, how many documents of the slice hold each, and per document which it holds how often."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = worker_aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for b in batches(source):
            figures, digests, key, times = aligner.align(b.column("text").to_pylist())
            pairs, held = np.unique(aligner.codes[key & 0xFFFFFFFF], return_inverse=True)
            order = np.lexsort((held, key >> 32))
            doc, held, times = (key >> 32)[order], held[order], times[order]
            sizes = np.bincount(doc, minlength=b.num_rows)
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, dtype=bool)
            steps = np.where(fresh, held, np.diff(held, prepend=0))  # ascending in each document
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([pairs], pa.list_(pa.int64())), pa.array([np.bincount(held, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())), *[pa.array([figures[:, i]], pa.list_(pa.int64())) for i in range(4)],
                pa.array([digests], pa.list_(pa.string())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), pa.array([_shut(steps)], pa.binary()), pa.array([_shut(times)], pa.binary()),
            ], ["block", "pairs", "holders", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "steps", "times"])
            number += 1

    return docs.mapInArrow(run, BLOCKS)


def _finished(answers: pa.Table, blocks: pa.Table) -> pa.Table:
    """Documents of one block, with the sums over their links."""
    row = blocks.drop_columns(["steps", "times"]).to_pylist()[0]
    sizes, n = np.array(row["sizes"], dtype=np.int64), len(row["doc_id"])
    total = int(sizes.sum())
    steps, times = (_opened(blocks[c][0].as_py(), total) for c in ("steps", "times"))
    at = np.concatenate([[0], np.cumsum(sizes)])
    run = np.cumsum(steps)
    held = run - np.repeat(np.concatenate([[0], run])[at[:-1]], sizes)
    count, best = np.zeros(answers.num_rows, dtype=np.int64), np.zeros(answers.num_rows, dtype=np.int64)
    place = answers["at"].to_numpy()
    count[place], best[place] = answers["n"].to_numpy(), answers["best"].to_numpy()
    sums = [np.concatenate([[0], np.cumsum(times * x[held])]) for x in (best, count)]
    columns = {c: pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {c: pa.array(s[at[1:]] - s[at[:-1]], pa.int64()) for c, s in zip(("n_best", "count_sum"), sums)}
    return pa.table(columns | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def align_documents(docs: DataFrame, byte_level: str, sentencepiece_model: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text of (doc_id, text).

    ``byte_level`` is the path of a byte-level tokenizers file (A), which encodes a
    blank and the text, ``sentencepiece_model`` that of a SentencePiece model (B),
    which puts its own blank in front. Both are read by the executors. Texts that
    are NULL or empty, or whose tokens do not give the text's bytes back, have no
    tokens: zeros and an empty string. Every row counts as a document: rows with
    a repeated or NULL doc_id stay, and each counts for the pairs it holds. Other
    columns are not read; an empty table gives an empty result.

    Texts are encoded once, in slices of a few MB, whose distinct id pairs are
    counted by partial aggregates and answered by an equi-join. Rows are linear in
    the text: a pair has one row per slice that holds it. Ties of an A id's highest
    count all are best; the window that finds it spans no more rows than B has ids.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = staged(_blocks(rows, byte_level, sentencepiece_model))
    counts = blocks.selectExpr("inline(arrays_zip(pairs, holders))").groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    counted = counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))).cast("bigint"))
    answers = blocks.selectExpr("block AS asked", "posexplode(pairs) AS (at, pair)").join(counted, "pair").select("asked", "at", "n", "best")
    return answers.groupBy("asked").cogroup(blocks.drop("pairs", "holders").groupBy("block")).applyInArrow(_finished, RESULT)
