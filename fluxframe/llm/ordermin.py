"""Order MinHash fingerprints of documents, sensitive to edit distance, and likeness of neighbours in id order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxframe.llm.text import batches, combine, mix, staged, word_hashes

#: Sketches in a fingerprint, k-mers chosen for each, words in a k-mer.
SKETCHES, CHOSEN, K = 64, 2, 2
#: Longer words are taken character by character, as in scripts without blanks.
LONG_WORD = 48
#: Hash values that are ranked at once.
CELLS = 1 << 21


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes per text; letters count as written, white space only parts words."""
    spaced = []
    for t in texts:
        if len(t) > LONG_WORD and max(map(len, t.split()), default=0) > LONG_WORD:
            t = " ".join(" ".join(w) if len(w) > LONG_WORD else w for w in t.split())
        spaced.append(t)
    return word_hashes(spaced, lower=False)


def occurrence_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of (k-mer, how often it came before), in text order; a text of fewer words is one k-mer."""
    if not len(words):
        return words
    k = min(k, len(words))
    kmers = combine([words[i : len(words) - k + 1 + i] for i in range(k)])
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    turn = np.empty(len(kmers), dtype=np.uint64)
    turn[order] = (np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))).astype(np.uint64)
    return mix(kmers + mix(turn + np.uint64(1)))


def sketch(kmers: np.ndarray, sketches: int = SKETCHES, chosen: int = CHOSEN) -> np.ndarray:
    """For each of the sketches: the ``chosen`` k-mers that its hash ranks lowest, in text order, hashed as a tuple.

    With fewer k-mers all are taken. A text without any has a sketch of its own.
    """
    if not len(kmers):
        return np.zeros(sketches, dtype=np.uint64)
    take = min(chosen, len(kmers))
    out = np.empty((sketches, take), dtype=np.int64)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    rows = max(1, CELLS // len(kmers))
    for i in range(0, sketches, rows):
        rank = kmers * factors[i : i + rows, None]
        for j in range(take):
            out[i : i + rows, j] = least = rank.argmin(axis=1)
            rank[np.arange(len(rank)), least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    out.sort(axis=1)
    return combine([kmers[out[:, j]] for j in range(take)])


def fingerprints(texts: list[str], k: int = K) -> np.ndarray:
    """One row of sketches per text, cut to the digits that are kept."""
    h, at = _tokens(texts)
    out = np.empty((len(texts), SKETCHES), dtype=">u2")
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        out[i] = sketch(occurrence_kmers(h[a:b], k)) >> np.uint64(48)
    return out


def as_text(row: np.ndarray) -> str:
    return row.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal parts of two fingerprints."""
    return float((a == b).mean())


def order_minhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of documents (doc_id, text): four hex digits for each of SKETCHES tuples.

    Equal texts have equal fingerprints; NULL and empty texts that of no words.
    Rows are independent; other columns are not read.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            prints = fingerprints(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(as_text, prints), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _judged(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> list[list]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = fingerprints(changed)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], [as_text(x) for x in prints],
        [as_text(x) for x in other], [likeness(x, y) for x, y in zip(prints, other)], [likeness(x, y) for x, y in zip(prints, next_prints)],
    ]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, with the likeness of both and that of the text to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Next is by descending doc_id, and the first document
    follows the last. Rows of one id go by a hash of their text, repeated rows in
    any order, NULL ids come last; a single row is its own next. A NULL text is
    empty. An empty table gives an empty result. Other columns are not read.

    One range exchange puts the rows in order, with a row number behind the id so
    that repeated ids are divided as well. Every task streams its range; only the
    first and last row of each range are put together with their neighbours
    afterwards, one pair per range.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[list, list[str], np.ndarray] | None = None
        for b in batches(source):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            prints = fingerprints(texts)
            if held is None:
                yield _row_batch([[None]] * len(NAMES), HEAD, part, texts[:1])
            else:
                ids, texts, prints = held[0] + ids, held[1] + texts, np.concatenate([held[2], prints])
            if len(ids) > 1:
                rows = _judged(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                yield _row_batch(rows, DONE, part, [None] * (len(ids) - 1))
            held = ids[-1:], texts[-1:], prints[-1:]
        if held is not None:
            yield _row_batch([held[0], *[[None]] * (len(NAMES) - 1)], TAIL, part, held[1])

    def close(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                both = fingerprints([text, following])
                yield _row_batch(_judged([i], [text], both[:1], [following], both[1:]), DONE, 0, [None])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("row").asc()]
    schema = f"{RESULT}, kind int, part int, text string"
    out = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, schema))
    heads = out.filter(F.col("kind") == HEAD).select(F.col("part").alias("at"), "text")
    after = Window.orderBy("at")  # one row per range
    chain = heads.select(
        "at", F.coalesce(F.lead("text").over(after), F.first("text").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    tails = out.filter(F.col("kind") == TAIL).select("doc_id", "text", "part")
    closed = tails.join(chain, F.col("part") == F.col("at")).select("doc_id", "text", "following").mapInArrow(close, schema)
    return out.filter(F.col("kind") == DONE).select(*NAMES).union(closed.select(*NAMES))


DONE, HEAD, TAIL = 0, 1, 2


def _row_batch(columns: list[list], kind: int, part: int, texts: list) -> pa.RecordBatch:
    n = len(texts)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())],
        [*NAMES, "kind", "part", "text"])
