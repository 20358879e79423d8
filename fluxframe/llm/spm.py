"""SentencePiece models on the tokenizers library: the model file is parsed and its tokenizer rebuilt."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from fluxframe.llm.text import batches, worker_state

# Fixed values of the model format: kinds of models and of pieces, and the marker for a blank.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARKER = "▁"
REMEMBER = 400_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; nested messages and strings as bytes, 32 and 64 bit values as bytes."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield number, raw[at : at + size]
            at += size


@dataclass
class SentencePieceModel:
    """What the model file says: pieces with scores and kinds, and how texts are normalised."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in fields(raw):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                trainer = dict(fields(value))
                model.kind, model.byte_fallback, model.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif number == 3:
                n = dict(fields(value))
                model.charsmap, model.dummy_prefix, model.squeeze_blanks, model.escape_blanks = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        return model

    def tokenizer(self) -> Tokenizer:
        """A tokenizers Tokenizer with the same pieces, ids, normaliser, marker and byte fallback."""
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE({p: i for i, (p, *_) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"models of kind {self.kind} are not supported")
        built, steps = Tokenizer(core), []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze_blanks:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARKER if self.escape_blanks else " "))
        if self.escape_blanks:
            steps.append(normalizers.Replace(" ", MARKER))
        built.normalizer = normalizers.Sequence(steps)
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        built.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return built

    def merges(self) -> list[tuple[str, str]]:
        """Merges of a BPE model: all ways to put a piece together from two, best-scored pieces first."""
        score = {p: s for p, s, k in self.pieces if k in (NORMAL, USER)}
        ways = []
        for i, (p, s, k) in enumerate(self.pieces):
            if k == NORMAL:
                ways += [(-s, i, cut, p[:cut], p[cut:]) for cut in range(1, len(p)) if p[:cut] in score and p[cut:] in score]
        return [(a, b) for *_, a, b in sorted(ways)]

    def cuts_at_blanks(self) -> bool:
        """Whether no piece holds a marker behind another character, so that a text may be cut in front of its single blanks."""
        return self.escape_blanks and not self.charsmap and not self.squeeze_blanks and all(MARKER not in p.lstrip(MARKER) for p, _, k in self.pieces if k == NORMAL)


class Codec:
    """Encodes and decodes batches of texts; distinct pieces between blanks are encoded once, on all threads the library is given."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        self.model = SentencePieceModel.parse(raw)
        self.tokenizer = self.model.tokenizer()
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.cuts = self.model.cuts_at_blanks() and self.model.dummy_prefix
        self.known: dict[str, tuple[bytes, bool, bool]] = {}

    def _learn(self, texts: list[str]) -> None:
        """Ids of texts from the rebuilt tokenizer, whether the sentencepiece library gives the same, and whether they decode to the text."""
        built = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        same = [ids == own for ids, own in zip(built, self.own.encode(texts, num_threads=1))]
        # One sequence of all pieces costs far less than one call each; only if it differs are they decoded one by one.
        if self.cuts and "" not in texts and self.tokenizer.decode([i for ids in built for i in ids], skip_special_tokens=False) == " ".join(texts):
            back = texts
        else:
            back = self.tokenizer.decode_batch(built, skip_special_tokens=False)
        self.known.update(zip(texts, zip((array("I", ids).tobytes() for ids in built), same, (b == t for b, t in zip(back, texts)))))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """Ids of each text, whether both libraries agree on all of its pieces, and whether all decode to what they were.

        The ids are the rebuilt tokenizer's; sentencepiece is only compared with. Every piece begins with
        the marker, so decoding, which works token by token but for runs of bytes,
        never joins two pieces: a text is decoded to itself where its pieces are.
        """
        if len(self.known) > REMEMBER:
            self.known.clear()
        # The marker in front of a text stands for a blank, so pieces between single blanks are texts of their own.
        plain = [self.cuts and t[:1] not in ("", " ", MARKER) and t[-1:] != " " and "  " not in t and MARKER not in t for t in texts]
        split = [t.split(" ") if p else [t] for t, p in zip(texts, plain)]
        new = list({p for pieces in split for p in pieces if p not in self.known})
        if new:
            self._learn(new)
        out = []
        for pieces in split:
            parts, same, back = zip(*[self.known[p] for p in pieces])
            out.append((np.frombuffer(b"".join(parts), dtype=np.uint32), all(same), all(back)))
        for p, t in zip(plain, texts):
            if not p:
                self.known.pop(t, None)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


def worker_codec(path: str) -> Codec:
    """The codec of this Python worker, kept between tasks."""
    return worker_state(("codec", path), lambda: Codec(path))


def encode_documents(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), parity and round_trip of every whole text.

    ``model`` is the path of a SentencePiece model that executors can read. parity
    says that the rebuilt tokenizer gives the sentencepiece library's ids;
    round_trip that decoding them returns the text as the model normalises it
    (NULL where ``verify`` is off). NULL and empty texts have no ids. Rows are
    independent, so NULL ids and repeated rows stay; other columns are not read.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for b in batches(source, most=1 << 20):
            texts = b.column("text").to_pylist()
            found = codec.encode(texts)
            ids = [i for i, *_ in found]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                pa.array([ok for _, ok, _ in found], pa.bool_()), pa.array([back if verify else None for *_, back in found], pa.bool_()),
            ], ["doc_id", "n_tokens", "ids", "parity", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, parity boolean, round_trip boolean")
