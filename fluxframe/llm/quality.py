"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.text import batches, over_batches, released, staged, worker_state

#: Expected number of documents drawn from the whole corpus as unlabelled text, by a hash of the id.
SAMPLE = 24_000
#: Expected number of trusted documents drawn as positives, by the same hash but with a share of their own. Nothing else is bounded.
POSITIVES = 24_000
#: Rows of either kind that a fit needs.
LEAST = 8
PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 sentence end, 3 symbol
_KIND[65:91] = 1
_KIND[[ord(c) for c in ".!?"]] = 2
_KIND[[ord(c) for c in "#$%&*+=|~^<>"]] = 3


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: character classes, word lengths, repetition. No vocabulary, so no language is favoured."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    size = max(1, len(raw))
    code = np.frombuffer(raw, dtype=np.uint8)
    by = np.bincount(code, minlength=256)
    edge = np.flatnonzero(np.diff(_SPACE[code], prepend=True, append=True))
    first, behind = edge[::2], edge[1::2]
    n, ws, lines = max(1, len(first)), raw.split(), raw.split(b"\n")
    lengths = behind - first if len(first) else np.zeros(1)
    heads, tails = np.bincount(_KIND[code[first]], minlength=4) / n, np.bincount(_KIND[code[behind - 1]], minlength=4) / n
    shape = [
        np.log1p(len(first)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(set(ws)) / n, sum(map(eq, ws, ws[1:])) / n,
        heads[1], heads[3], tails[1], tails[2], tails[3],
        len(set(lines)) / len(lines), np.log1p(size / len(lines)), np.log1p(len(lines)), len(zlib.compress(raw, 1)) / size,
        by[65:91].sum() / size, by[97:123].sum() / size, by[48:58].sum() / size, (by[9:14].sum() + by[32]) / size, by[128:].sum() / size,
        (by[:9].sum() + by[14:32].sum() + by[127]) / size,
    ]
    return np.concatenate([shape, np.log1p(1000.0 * by[PUNCTUATION] / size)])


@dataclass
class Model:
    """Linear model on standardised features; without weights every score is ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return _sigmoid(_design((x - self.mean) / self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _design(z: np.ndarray) -> np.ndarray:
    """Clipped features, their squares and a constant."""
    z = np.clip(z, -6.0, 6.0)
    return np.hstack([z, z * z / 6.0, np.ones((len(z), 1))])


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: best-bin estimate.

    A plain positive-against-unlabelled classifier is fitted on one half of the
    rows. On the other half, the share of unlabelled rows above a threshold over
    that of positives bounds the prior from above at every threshold; the
    threshold with the least bound, confidence terms included, gives the estimate.
    """
    fit_p, fit_u, p, u = positive[::2], unlabelled[::2], positive[1::2], unlabelled[1::2]

    def gradient(w):
        return (-(fit_p.T @ (1 - _sigmoid(fit_p @ w))) / len(fit_p) + fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u)) / 2 + 1e-3 * w

    w = _descend(gradient, positive.shape[1], 200, 0.02)
    sp, su = np.sort(p @ w), np.sort(u @ w)
    at = np.unique(sp[: max(1, int(0.99 * len(sp)))])
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
    best = np.argmin((above_u + 1.01 * slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.02, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss.

    Risk: prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)]). Where the second
    part turns negative, the step goes up its slope instead, so the model cannot
    fit unlabelled positives as negatives. With fewer than 8 rows of either kind
    nothing is fitted and all scores are the prior (0.5 unless given).
    """
    if min(len(positive), len(unlabelled)) < LEAST:
        return Model(0.5 if prior is None else prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = _design((positive - mean) / scale), _design((unlabelled - mean) / scale)
    prior = class_prior(p, u) if prior is None else prior

    def gradient(w):
        fp, fu = p @ w, u @ w
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = prior * (p.T @ (1 - _sigmoid(fp))) / len(p)
        down = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        return (-up + down if rest >= 0 else -down) + ridge * w

    return Model(prior, mean, scale, _descend(gradient, p.shape[1], steps, rate))


def _with_features(docs: DataFrame) -> DataFrame:
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), b.column("drawn"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "drawn", "x"])

    return docs.mapInArrow(over_batches(work), "doc_id bigint, good boolean, drawn boolean, x array<double>")


def _share(expected: int, total: int) -> Column:
    """Whether a doc_id lies in a draw of about ``expected`` of ``total`` rows."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, expected / max(1, total)) * (1 << 30)))


def fit_quality(docs: DataFrame, trusted: DataFrame, usable: Column | None = None, sample: int = SAMPLE, positives: int = POSITIVES) -> Model:
    """Model from documents (doc_id, text) and ``trusted``, a table of the doc_ids known to be good.

    Only rows where ``usable`` (an expression of doc_id) holds take part. About
    ``sample`` of all documents are unlabelled web text, and about ``positives``
    of the trusted documents are positives, however small their share of the
    corpus. Both are drawn by a hash of doc_id. Only their features travel, and
    they alone reach the driver. Trusted documents that are too few for a fit are
    an error; without any, or in a corpus of fewer than LEAST documents, every
    score is 0.5.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    rows = rows if usable is None else rows.filter(usable)
    good = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    named = staged(rows.select("doc_id").join(good, "doc_id", "left"))
    total, known = named.agg(F.count("doc_id"), F.count("good")).first()
    if not known or total < LEAST:
        return Model(0.5)
    picked = named.filter(F.col("good") & _share(positives, known)).distinct()  # bounded, so it is broadcast
    drawn = rows.join(F.broadcast(picked), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))).withColumn("drawn", _share(sample, total))
    table = _with_features(drawn.filter("good OR drawn")).toArrow()
    order = np.lexsort((table["doc_id"].to_numpy(),))
    is_good, is_drawn = (table[c].to_numpy()[order].astype(bool) for c in ("good", "drawn"))
    if min(is_good.sum(), is_drawn.sum()) < LEAST:
        raise ValueError(f"{is_good.sum()} of {known} trusted documents and {is_drawn.sum()} of all {total} were drawn; a fit needs {LEAST} of each")
    x = np.stack(table["x"].to_numpy())[order]
    return fit_pu(x[is_good], x[is_drawn])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted): one row per input row, scored where it lies.

    NULL and empty texts get the score of an empty text's features. Repeated rows
    and NULL ids are scored like any other; other columns are not read.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(np.stack([features(t) for t in b.column("text").to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(over_batches(work), "doc_id bigint, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents all of whose known quality labels are 1."""
    return labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with all their columns, whatever their names.

    Texts are judged where they lie, in slices of bounded size, so nothing is
    shuffled. NULL and empty texts are judged by an empty text's features; rows
    with repeated or NULL ids are judged each by its own text.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        for b in batches(source, most=1 << 20):
            x = np.stack([features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield b.filter(pa.array(model.score(x) >= 0.5))
        released()

    return docs.mapInArrow(run, docs.schema)
