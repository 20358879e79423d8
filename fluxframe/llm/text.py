"""Word hashes, folds and stages shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxframe.session import staged

__all__ = ["END", "batches", "combine", "fold", "mix", "released", "staged", "word_hashes", "words", "worker_state"]

#: Texts longer than this are hashed piece by piece, cut at white space.
PIECE_BYTES = 4 << 20
#: Hash of the token that ends a text. No word gets it: words are never empty.
END = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a NULL id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes methods know ASCII only, which is the rule here."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of tuples of hashes, position by position."""
    out = np.zeros_like(parts[0])
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(1))
    return out


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lower-cased or as written, and the offset at which each text's words begin (one more at the end)."""
    hashes, counts, pending, size = [], np.zeros(len(texts) + 1, dtype=np.int64), [], 0

    def flush():
        if pending:
            hashes.append(pd.util.hash_array(np.array(pending, dtype=object), categorize=False))
            pending.clear()

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        raw = raw.lower() if lower else raw
        at = 0
        while at < len(raw):
            to = len(raw)
            if to - at > PIECE_BYTES:
                to = at + PIECE_BYTES
                while to < len(raw) and raw[to] not in b" \t\n\r\x0b\x0c":
                    to += 1
            ws = raw[at:to].split()
            counts[i + 1] += len(ws)
            pending.extend(ws)
            size += to - at
            if size > PIECE_BYTES:
                flush()
                size = 0
            at = to
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), np.cumsum(counts)


def batches(source: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``most`` bytes of text each (one row at least)."""
    for b in source:
        if not b.num_rows:
            continue
        column = b.column(b.schema.get_field_index(text))
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def over_batches(work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> Callable:
    """``mapInArrow`` function that applies ``work`` to slices of bounded text size."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        for b in batches(source, text):
            yield work(b)
        released()

    return run


def released() -> None:
    """Give memory that this Python worker no longer uses back to the system: workers outlive their tasks and sit beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def worker_state(key: Any, make: Callable[[], Any] | None = None) -> Any:
    """What this Python worker keeps between tasks under ``key``. A worker serves many stages, so another operator's state goes before; without ``make`` nothing is kept."""
    kept = sys.modules.setdefault("_worker_state", ModuleType("_worker_state")).__dict__.setdefault("by_key", {})
    if key not in kept:
        kept.clear()
        released()
        if make is not None:
            kept[key] = make()
    return kept.get(key)

