"""Language-model scores by deleted interpolation of bigram and unigram estimates.

Documents are gathered, where they are read, into blocks of bounded size. A
block's distinct tokens and pairs are counted in the task and sent, as sorted
runs cut by hash range, to the tasks that add up the counts; these answer with
the totals in the same order. So an n-gram travels once per block, however
frequent it is, and no key is hot. Texts are kept with their block, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.text import END, batches, staged, word_hashes

#: Text in a block; a longer document is a block of its own.
BLOCK_BYTES = 10 << 20
#: N-grams that one counting task holds, about.
RANGE_GRAMS = 600_000
#: Context buckets: by the bit length of the context's count.
BUCKETS = 33
#: Log-ratio bins of the statistics that the weights are learned from.
BINS, LOW, HIGH = 1600, -12.0, 20.0

BLOCK = "block bigint, doc_ids array<bigint>, parts array<int>, texts binary, grams bigint"


def _pairs(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text, END before the first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = END
    out = before * np.uint64(0x9E3779B97F4A7C15) + (h ^ np.uint64(0xD1B54A32D192ED03))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Tokens:
    """Token hashes of a block's texts, each text closed by END."""

    def __init__(self, texts: list[str]):
        h, at = word_hashes(texts)
        n = np.diff(at)
        self.starts = np.concatenate([[0], np.cumsum(n + 1)])
        self.words = np.full(self.starts[-1], END, dtype=np.uint64)
        keep = np.ones(len(self.words), dtype=bool)
        keep[self.starts[1:] - 1] = False
        self.words[keep] = h
        self.pairs = _pairs(self.words, self.starts[:-1]) if len(texts) else self.words

    def grams(self) -> list[np.ndarray]:
        return [self.words, self.pairs]


def _pack(texts: list[str]) -> bytes:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    head = np.array([len(raw), *map(len, raw)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def _unpack(blob: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, dtype=np.int64, count=n, offset=8))
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([8 * (n + 1), *ends[:-1]], ends)]


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, part) in blocks, one row each, written to the shared folder so that every later step sees the same blocks."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        open_blocks = {False: ([], [], []), True: ([], [], [])}
        sizes = {False: 0, True: 0}

        def closed(tuning: bool) -> pa.RecordBatch:
            nonlocal count
            ids, parts, texts = open_blocks[tuning]
            row = pa.RecordBatch.from_arrays([
                pa.array([(task << 24) + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([parts], pa.list_(pa.int32())),
                pa.array([_pack(texts)], pa.binary()), pa.array([sum(t.count(" ") + t.count("\n") + 2 for t in texts)], pa.int64()),
            ], ["block", "doc_ids", "parts", "texts", "grams"])
            open_blocks[tuning], sizes[tuning], count = ([], [], []), 0, count + 1
            return row

        for b in batches(source, most=1 << 20):
            for row in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text").to_pylist()):
                tuning = row[1] == 2  # blocks of their own, so that learning the weights reads them alone
                for column, x in zip(open_blocks[tuning], row):
                    column.append(x)
                sizes[tuning] += len(row[2]) + 64
                if sizes[tuning] >= BLOCK_BYTES:
                    yield closed(tuning)
        for tuning, columns in list(open_blocks.items()):
            if columns[0]:
                yield closed(tuning)

    return staged(docs.mapInArrow(run, BLOCK))


RUN = "place int, block bigint, grams int, train binary, hashes binary"


def _ascending(g: np.ndarray) -> bytes:
    """Ascending hashes, all 64 bits of them: the first one, then the steps between them in the fewest bytes that hold every step; the first byte says how many."""
    steps = np.diff(g)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + g[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _hashes(blob: bytes) -> np.ndarray:
    raw, width = np.frombuffer(blob, dtype=np.uint8), blob[0]
    out = np.zeros((1 + (len(raw) - 9) // width, 8), dtype=np.uint8)
    out[0] = raw[1:9]
    out[1:, :width] = raw[9:].reshape(-1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes; the first byte says how many each takes."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _large(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def _runs(table: DataFrame, places: int) -> DataFrame:
    """Per block and hash range: the block's distinct n-grams there, ascending, with their counts in training documents."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for block, parts, blob in zip(b.column("block").to_pylist(), b.column("parts").to_pylist(), b.column("texts").to_pylist()):
                t = Tokens(_unpack(blob))
                part = np.repeat(np.array(parts, dtype=np.int8), np.diff(t.starts))
                for order, grams in enumerate(t.grams()):
                    sort = np.argsort(grams)
                    g, p = grams[sort], part[sort]
                    first = np.flatnonzero(np.diff(g, prepend=~g[:1]))
                    train = np.add.reduceat((p > 0).astype(np.int64), first)
                    g = g[first]
                    at = ((g >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
                    cut = np.append(np.flatnonzero(np.diff(at, prepend=np.uint64(places))), len(g))
                    rows = [(int(at[i]) * 2 + order, block, int(j - i), _small(train[i:j]), _ascending(g[i:j])) for i, j in zip(cut[:-1], cut[1:])]
                    names = ["place", "block", "grams", "train", "hashes"]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                    for k in range(0, len(rows), 512):
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[k : k + 512]), kinds)], names)

    return table.mapInArrow(run, RUN)


def _add_up(group: pa.Table) -> pa.Table:
    """Totals of one hash range: for each block, the totals of its n-grams in its order; and, as block -1, the range's own figures."""
    sizes = group["grams"].to_numpy()
    g = np.concatenate([_hashes(x) for x in group["hashes"].to_pylist()])
    train = np.concatenate([_large(x) for x in group["train"].to_pylist()])
    sort = np.argsort(g)
    first = np.flatnonzero(np.diff(g[sort], prepend=~g[sort[:1]]))
    which = np.empty(len(g), dtype=np.int64)
    which[sort] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
    total = np.add.reduceat(train[sort], first)
    ends = np.cumsum(sizes)[:-1]
    place = group["place"][0].as_py()
    return pa.table({
        "place": pa.array([place] * (len(sizes) + 1), pa.int32()),
        "block": pa.array([*group["block"].to_pylist(), -1], pa.int64()),
        "totals": pa.array([*map(_small, np.split(total[which], ends)), b""], pa.binary()),
        "types": pa.array([0] * len(sizes) + [int((total > 0).sum())], pa.int64()),
        "tokens": pa.array([0] * len(sizes) + [int(total.sum())], pa.int64()),
    })


def _totals(totals: list[tuple[int, bytes]], order: int) -> np.ndarray:
    parts = [_large(blob) for place, blob in sorted(totals) if place % 2 == order]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


@dataclass
class Interpolation:
    """P(w|v) = b[c(v)] * c(vw)/c(v) + (1 - b[c(v)]) * P(w);  P(w) = a * c(w)/N + (1 - a) / (V + 1)."""

    tokens: int
    types: int
    unigram: float
    bigram: np.ndarray

    def lower(self, c: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.unigram * c / np.maximum(n, 1) + (1 - self.unigram) / (self.types + 1)


def bucket(c: np.ndarray) -> np.ndarray:
    """Context bucket of a count: its bit length, 0 for an unseen context."""
    return np.where(c > 0, np.minimum(np.frexp(np.maximum(c, 1).astype(np.float64))[1], BUCKETS - 1), 0).astype(np.int64)


def _log_ratio_bin(r: np.ndarray) -> np.ndarray:
    """Bin 0 for ratio 0, else by the natural logarithm."""
    with np.errstate(divide="ignore"):
        at = np.floor((np.log(r) - LOW) / (HIGH - LOW) * (BINS - 1)) + 1
    return np.where(r > 0, np.clip(np.nan_to_num(at, neginf=0), 1, BINS - 1), 0).astype(np.int64)


def em_weight(counts: np.ndarray, sums: np.ndarray, start: float = 0.5, steps: int = 200) -> float:
    """Weight of the upper part in a mixture of two, by expectation-maximisation.

    ``counts[i]`` held-out tokens have the mean ratio ``sums[i] / counts[i]`` of the
    upper probability to the lower one, which is all that the likelihood depends on.
    """
    n = counts.sum()
    if n == 0:
        return 0.0
    r, w = sums / np.maximum(counts, 1), start
    for _ in range(steps):
        w = float((counts * (w * r) / (w * r + 1 - w)).sum() / n)
        if w <= 0.0 or w >= 1.0:
            break
    return min(max(w, 0.0), 1.0 - 1e-9)


def _counts(t: Tokens, totals: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """c(w), c(v) and c(vw) of every token (END's own count for a first token's context), and each order's (n-gram number, distinct n-grams)."""
    found, names = [], []
    for order, grams in enumerate(t.grams()):
        distinct, number = np.unique(grams, return_inverse=True)
        found.append(_totals(totals, order)[number])
        names.append(number)
    c, pair = found
    context = np.empty_like(c)
    context[1:] = c[:-1]
    context[t.starts[:-1]] = c[t.starts[1:] - 1]
    return c, context, pair, names


def _own(number: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each token's n-gram occurs in its own text."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = text * np.int64(number.max() + 1 if len(number) else 1) + number
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at]


STATS = "level int, bin int, counts double, sums double"


def _tuning(table: DataFrame, tokens: int, types: int, weight: float | None) -> DataFrame:
    """Held-out statistics of the tuning part: each document's own counts are deleted from the totals before it is looked up.

    Without ``weight``, those of unigrams against the uniform distribution; with it, those of bigrams against unigrams, by context bucket.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(BUCKETS * BINS), np.zeros(BUCKETS * BINS)
        for b in source:
            for parts, blob, totals in zip(b.column("parts").to_pylist(), b.column("texts").to_pylist(), b.column("totals").to_pylist()):
                t = Tokens(_unpack(blob))
                c, context, pair, names = _counts(t, [(x["place"], x["totals"]) for x in totals])
                length = np.diff(t.starts)
                tune = np.repeat(np.array(parts) == 2, length)
                own, own_pair = _own(names[0], t.starts), _own(names[1], t.starts)
                own_context = np.empty_like(own)
                own_context[1:] = own[:-1]
                own_context[t.starts[:-1]] = own[t.starts[1:] - 1]
                n = np.repeat(tokens - length, length)
                c, context, pair = (x[tune] for x in (c - own, context - own_context, pair - own_pair))
                low = Interpolation(tokens, types, weight or 0.0, np.zeros(0)).lower(c, n[tune])
                if weight is None:
                    level, r = np.zeros(len(c), dtype=np.int64), c / np.maximum(n[tune], 1) / low
                else:
                    level, r = bucket(context), pair / np.maximum(context, 1) / low
                at = level * BINS + _log_ratio_bin(r)
                counts += np.bincount(at, minlength=BUCKETS * BINS)
                sums += np.bincount(at, weights=r, minlength=BUCKETS * BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(counts[at]), pa.array(sums[at])],
                                         ["level", "bin", "counts", "sums"])

    return table.mapInArrow(run, STATS).groupBy("level", "bin").agg(F.sum("counts").alias("counts"), F.sum("sums").alias("sums"))


def _weights(stats: DataFrame, default: float) -> np.ndarray:
    """EM in every bucket on the bounded table of its bins; ``default`` where nothing is held out."""
    found = stats.orderBy("level", "bin").toArrow()
    level, counts, sums = (found[c].to_numpy() for c in ("level", "counts", "sums"))
    return np.array([em_weight(counts[level == k], sums[level == k]) if (level == k).any() else default for k in range(BUCKETS)])


SCORES = "doc_id bigint, part int, n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(table: DataFrame, model: Interpolation) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for ids, parts, blob, totals in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "parts", "texts", "totals"))):
                t = Tokens(_unpack(blob))
                c, context, pair, _ = _counts(t, [(x["place"], x["totals"]) for x in totals])
                weight = model.bigram[bucket(context)]
                p = weight * pair / np.maximum(context, 1) + (1 - weight) * model.lower(c, model.tokens)
                base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                at = t.starts[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(np.diff(t.starts)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                    pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
                ], ["doc_id", "part", "n_tokens", "n_known", "base_score", "score"])

    return table.mapInArrow(run, SCORES)


def lm_scores(docs: DataFrame, part: Column) -> DataFrame:
    """Score every whole text: doc_id, part, n_tokens, n_known, train_tokens, base_score, score.

    ``part`` of a document: 0 is scored only, 1 and 2 are training; the mixture
    weights are learned on part 2, whose documents are held out of the counts one
    by one for that (without any, the weights are 0.9 and 0.5). Tokens are words of ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased and an end token. base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))), score the interpolated model's log10
    probability. All counts cover all training documents.

    NULL and empty texts hold the end token alone. NULL ids and repeated rows are
    scored like others. Without training documents base_score is 0 and score that of
    one type. An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), part.cast("int").alias("part"))
    table = blocks(rows)
    grams = table.agg(F.sum("grams")).first()[0] or 0
    places = max(4, -(-grams // RANGE_GRAMS))
    runs = _runs(table, int(places))
    sums = staged(runs.groupBy("place").applyInArrow(_add_up, "place int, block bigint, totals binary, types bigint, tokens bigint"))
    own = sums.filter("block = -1 AND place % 2 = 0").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = own
    answers = sums.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("place", "totals")).alias("totals"))  # a block's own n-grams: bounded
    met = table.select("block", "doc_ids", "parts", "texts").join(answers, "block")
    tuning = met.filter("array_contains(parts, 2)")
    unigram = float(_weights(_tuning(tuning, tokens, types, None), 0.9)[0])
    bigram = _weights(_tuning(tuning, tokens, types, unigram), 0.5)
    bigram[0] = 0.0
    return _scored(met, Interpolation(tokens, types, unigram, bigram)).withColumn("train_tokens", F.lit(tokens).cast("bigint"))
