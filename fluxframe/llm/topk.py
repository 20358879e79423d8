"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors."""

from __future__ import annotations

import string
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxframe.llm.text import staged

#: Vectors in a block of candidates and of queries; dimensions that are added at a time.
CANDIDATES, QUERIES, DIMENSIONS = 1024, 256, 16
#: Bytes of queries that a task holds, pairs of blocks that it meets at least and that more tasks are made for, and tasks up to which more are made.
HELD, LEAST_PAIRS, PAIRS, TASKS = 16 << 20, 64, 1 << 16, 10_000
#: Blocks of queries in a part at least and at most, and blocks of candidates in a file.
PART, FILE = (8, 64), 64
#: Share of pairs from which on they are followed one by one, and share of queries x candidates from which on they are closed up.
THIN, CLOSE = 0.03, 0.4
#: Products of norms from here on are an error: their score could overflow a 64-bit integer.
LARGEST = 2.0**63 * (1 - 1e-9)

BLOCK = "ids binary, cells binary, width int"


def scaled(vector: str = "embedding", scale: float = 256.0) -> Column:
    """floor(scale * component) as integers; NULL for a vector that is NULL or has a NULL or non-finite component."""
    bad = f"exists({vector}, x -> x IS NULL OR isnan(CAST(x AS double)) OR abs(CAST(x AS double)) = double('infinity'))"
    cell = f"floor({scale}D * CAST(x AS double))"  # a bigint; what does not fit is its largest value, which search takes for an overflow
    return F.expr(f"CASE WHEN {vector} IS NULL OR {bad} THEN NULL ELSE transform({vector}, x -> {cell}) END")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors in vertical layout, one row each: ids, and the cells dimension by dimension in the smallest type, shorter vectors filled with 0."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                vectors = part.column("vector")
                lengths = np.diff(vectors.offsets.to_numpy())
                cells = np.zeros((max(1, int(lengths.max())), part.num_rows), dtype=np.int64)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), lengths)
                cells[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
                cells = cells.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= cells.min() and cells.max() <= np.iinfo(t).max))
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()), pa.array([len(cells)], pa.int32())], ["ids", "cells", "width"])

    return rows.mapInArrow(run, BLOCK)


class Side:
    """Vectors, ``cells`` being dimension by vector, and the norms that remain behind every ``step`` dimensions."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, step: int = DIMENSIONS):
        self.ids, self.cells, self.step, self.cast, self.spaces = ids, cells, step, {}, {}
        squares = [np.square(cells[s : s + step].astype(np.float64)).sum(axis=0) for s in range(0, len(cells), step)]
        self.norms = np.sqrt(np.cumsum([np.zeros(len(ids)), *squares[::-1]], axis=0)[::-1])
        self.order = np.argsort(ids, kind="stable")

    def rest(self, i: int) -> np.ndarray:
        return self.norms[min(i, len(self.norms) - 1)]

    def slab(self, i: int, kind: type, most: int) -> np.ndarray:
        """The i-th step's dimensions, of the first ``most`` dimensions."""
        if kind not in self.cast:
            self.cast[kind] = self.cells.astype(kind)
        return self.cast[kind][i * self.step : min((i + 1) * self.step, most)]

    def space(self, use: str, rows: int, kind: type) -> np.ndarray:
        """A matrix to write into, the same one for as many rows: new memory costs more than the sums in it."""
        key = use, rows, kind
        if key not in self.spaces:
            self.spaces[key] = np.empty((rows, len(self.ids)), dtype=kind)
        return self.spaces[key]


def branch_and_bound(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, step: int = DIMENSIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (row of ``queries``): ids and scores of the k best candidates of one block that reach the query's ``floor``.

    ``cells`` is dimension by candidate.
    """
    return bounded(Side(query_ids, queries.T, step), Side(ids, cells, step), k, floor)


def bounded(q: Side, c: Side, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``branch_and_bound`` of two sides.

    Scores grow by a step of dimensions at a time, for all queries at once; what
    a pair can still gain is at most the product of the remaining norms
    (Cauchy-Schwarz), and pairs that cannot reach the floor or, for a query
    without one, the k-th best certain score are dropped. Queries and candidates
    without pairs are closed up, and the last few pairs are followed one by one.
    Scores are whole numbers, added up in floats only where the product of the
    norms shows that floats hold them exactly.
    """
    steps, width = max(len(q.norms), len(c.norms)) - 1, min(len(q.cells), len(c.cells))
    largest = q.rest(0).max(initial=0) * c.rest(0).max(initial=0)
    own = c.order[np.clip(np.searchsorted(c.ids, q.ids, sorter=c.order), 0, len(c.ids) - 1)] if len(c.ids) else np.zeros(0, dtype=np.int64)
    own = q.ids[:, None] == c.ids if len(own) and (c.ids[own] == q.ids).any() else None
    if largest >= LARGEST:
        bad = np.multiply.outer(q.rest(0), c.rest(0)) >= LARGEST
        bad = (bad if own is None else bad & ~own).any(axis=1)
        if bad.any():
            raise OverflowError(f"scores of vector {q.ids[bad.argmax()]} could overflow 64 bits")
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    real, rounding = (np.float32, 1e-6) if kind is np.float32 else (np.float64, 1e-9)
    low, free = floor.astype(real), floor < -LARGEST
    slack = lambda a, b: 1 + rounding * q.rest(0)[a] * c.rest(0)[b] if kind is np.int64 else 1
    rows, cols, i = np.arange(len(q.ids)), np.arange(len(c.ids)), 1
    score, rest, more, alive = (c.space(use, len(q.ids), t) for use, t in (("score", kind), ("rest", real), ("more", kind), ("alive", bool)))
    np.matmul(q.slab(0, kind, width).T, c.slab(0, kind, width), out=score)
    while True:
        if i < steps:
            np.multiply.outer((q.rest(i)[rows] * (1 + rounding)).astype(real), c.rest(i)[cols].astype(real), out=rest)
            rest += slack(rows[:, None], cols)
        else:
            rest.fill(0)
        lift = np.flatnonzero(free[rows])
        if len(lift) and len(cols) >= k:
            certain = score[lift] - rest[lift]
            if own is not None:
                certain[own[lift]] = -np.inf
            low[rows[lift]] = np.maximum(low[rows[lift]], np.partition(certain, len(cols) - k, axis=1)[:, len(cols) - k])
        rest += score
        np.greater_equal(rest, low[rows, None], out=alive)
        if own is not None:
            alive &= ~own
        left = np.count_nonzero(alive)
        if i >= steps or left <= THIN * alive.size:
            break
        some, any_of = alive.any(axis=1), alive.any(axis=0)
        if np.count_nonzero(some) * np.count_nonzero(any_of) < CLOSE * alive.size:
            rows, cols, score = rows[some], cols[any_of], score[some][:, any_of]
            own = None if own is None else own[some][:, any_of]
            rest, more, alive = (np.empty(score.shape, dtype=t) for t in (real, kind, bool))
        a, b = q.slab(i, kind, width), c.slab(i, kind, width)
        np.matmul((a if len(rows) == len(q.ids) else a[:, rows]).T, b if len(cols) == len(c.ids) else b[:, cols], out=more)
        score += more
        i += 1
    a, b = np.divmod(np.flatnonzero(alive), max(1, len(cols)))  # nonzero() of two dimensions is far slower
    score, a, b = score[a, b], rows[a], cols[b]
    for i in range(i, steps):
        score = score + (q.slab(i, kind, width)[:, a] * c.slab(i, kind, width)[:, b]).sum(axis=0, dtype=kind)
        keep = score + (q.rest(i + 1)[a] * (1 + rounding) * c.rest(i + 1)[b] + slack(a, b) if i + 1 < steps else 0) >= low[a]
        score, a, b = score[keep], a[keep], b[keep]
    score, ids = score.astype(np.int64), c.ids[b]
    order = np.lexsort((ids, -score, a))
    a, ids, score = a[order], ids[order], score[order]
    ends = np.searchsorted(a, np.arange(len(q.ids) + 1))
    none = ids[:0], score[:0]
    return [(ids[s : min(s + k, e)], score[s : min(s + k, e)]) if s < e else none for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _files(table: DataFrame) -> tuple[str, list[str]]:
    """Folder of a written table, and its files. Spark leaves letters beyond ASCII in URIs, where pyarrow takes none."""
    paths = sorted(table.inputFiles())
    return quote(paths[0].rpartition("/")[0] if paths else "", safe=string.printable), [p.rpartition("/")[2] for p in paths]


def _sides(folder: str, names: list[str]) -> Iterator[Side]:
    """Blocks of a written table, one at a time."""
    if names:
        store, base = fs.FileSystem.from_uri(folder)
    for name in names:
        with store.open_input_file(f"{base}/{name}") as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                for ids, raw, width in zip(*(b.column(c) for c in ("ids", "cells", "width"))):
                    ids, raw, width = np.frombuffer(ids.as_buffer(), np.int64), raw.as_buffer(), width.as_py()
                    yield Side(ids, np.frombuffer(raw, f"i{raw.size // (width * len(ids))}").reshape(width, -1))


def _turns(queries: Iterator[Side]) -> Iterator[list[Side]]:
    """Blocks of queries, as many at a time as a task holds."""
    held, size = [], 0
    for q in queries:
        if held and size + 8 * q.cells.size > HELD:
            yield held
            held, size = [], 0
        held, size = [*held, q], size + 8 * q.cells.size
    if held:
        yield held


def _shares(candidates: int, queries: int, cores: int) -> tuple[int, int]:
    """Parts of the candidates and of the queries, for so many blocks of both: each pair of parts is a task."""
    pairs = candidates * queries
    tasks = max(1, min(4 * cores, pairs // LEAST_PAIRS), min(TASKS, pairs // PAIRS))
    parts = max(1, min(max(tasks, -(-queries // PART[1])), -(-queries // PART[0])))
    return max(1, min(candidates, -(-tasks // parts))), parts


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, groups: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query over all other rows, ties to the smaller id.

    ``is_query`` picks the queries among the rows. Components are
    floor(256 * x); vectors that are NULL or hold a NULL or non-finite component,
    and rows with a NULL id, take no part. Shorter vectors count as filled with
    zeros. Where the
    product of two norms shows that a score could overflow 64 bits, the search is
    an error. A row is no candidate of its own
    id; repeated rows are candidates like others, and an id asks once, with its
    smallest vector. A query with fewer than k candidates gets all of them. An empty table
    gives an empty result. Other columns are not read.

    Rows lie in blocks in vertical layout, in two written tables. Every block of
    queries meets every block of candidates: a task takes a part of the files of
    both (``groups`` parts of the candidates), holds some of its queries at a time
    and reads its candidates block by block, so that blocks are neither joined,
    exchanged nor broadcast. The k best so far of a query are its floor; only they
    leave the task, and Spark limits them to k again.
    """
    spark = vectors.sparkSession
    cells = vectors.select(F.col(key).cast("bigint").alias("vec_id"), scaled(vector).alias("vector"), is_query.alias("asks")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    stored = staged(cells)
    total, asks = stored.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks = -(-total // CANDIDATES)
    shares, parts = _shares(blocks, -(-asks // QUERIES), spark.sparkContext.defaultParallelism)
    groups = groups or shares
    dealt = groups * max(1, -(-blocks // (groups * FILE)))
    candidates = _files(staged(_blocks(stored.select("vec_id", "vector").repartition(dealt), CANDIDATES)))
    asking = _files(staged(_blocks(stored.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).repartition(parts), QUERIES)))

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in source for t in b.column("id").to_pylist()):
            for queries in _turns(_sides(asking[0], asking[1][task // groups :: parts])):
                # The k best of every query, the worst first: no score is as low as an empty place's.
                ids, scores = ([np.full((len(q.ids), k), empty) for q in queries] for empty in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
                for c in _sides(candidates[0], candidates[1][task % groups :: groups]):
                    for q, best, score in zip(queries, ids, scores):
                        for i, (found, s) in enumerate(bounded(q, c, k, score[:, 0].astype(np.float64))):
                            if len(s) and (s[0] > score[i, 0] or (s[0] == score[i, 0] and found[0] < best[i, 0])):
                                found, s = np.concatenate([best[i], found]), np.concatenate([score[i], s])
                                order = np.lexsort((~found, s))[-k:]
                                best[i], score[i] = found[order], s[order]
                for q, best, score in zip(queries, ids, scores):
                    known = score > np.iinfo(np.int64).min
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, known.sum(axis=1))), pa.array(best[known]), pa.array(score[known])], ["query_id", "vec_id", "score"])

    found = spark.range(0, groups * parts, 1, groups * parts).mapInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
