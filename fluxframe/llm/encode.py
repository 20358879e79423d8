"""Token ids of many texts with the tokenizers library, encoding each distinct word once."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from fluxframe.llm.text import worker_state

#: Characters that no Unicode version counts as white space, as a class: printable ASCII and Latin letters.
SAFE = "!-~À-ɏ"
_CUT = re.compile(f"(?<=[{SAFE}])(?=[ \\n][{SAFE}])")
_IS_SAFE = re.compile(f"[{SAFE}]").match
#: Marks that may close a word; none of them begins an English contraction.
MARKS = ".,;:!?#$%&*+=|\"()[]{}<>/-"
#: Words, and as many pieces, that one encoder remembers before it forgets those that did not recur.
WORDS = 600_000
#: Words that are encoded in one text.
LINES = 400
#: What some vocabularies put behind the last letter of a word.
WORD_END = "</w>"
#: Without U+0130, which two characters replace when it is folded.
_IS_LATIN = re.compile("[A-Za-zÀ-\u012f\u0131-ɏ]+").fullmatch
#: Byte-level vocabularies write bytes that are no visible Latin letter as the letters from U+0100 on, in order.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN) if b != 0x0A}


def _letters(lines: str) -> str:
    """Words, one a line, with their bytes as a byte-level vocabulary writes them."""
    return lines.encode("utf-8").decode("latin-1").translate(_LETTERS)


class PieceEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A byte-level or word BPE splits texts into words before it merges, and a
    single blank or line end between two safe characters always ends a word. So
    a text may be cut in front of each such blank and its pieces encoded apart,
    which pays as most pieces recur. A piece of Latin letters and closing marks
    is put together from its two parts. Other white space stays inside its piece.
    The first texts of every encoder are compared with the tokenizer's result.
    """

    def __init__(self, path: str, check: int = 6, remember: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        same = lambda a, b: self._plain([a])[0] == self._plain([b])[0]
        self.folds, self.blanks = same("Ab", "ab"), not same(" ab", "ab")
        # Letters of a byte-level entry are its bytes; a word BPE may mark a word's end.
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.sizes = np.array([len(e.removesuffix(WORD_END)) for e in entries], dtype=np.int64)
        self.byte_level = self.blanks and not self.folds and "Ġ" in entries
        # Takes words as they are, one a line, and skips the tokenizer's own splitting.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = CharDelimiterSplit("\n")
        self.check, self.remember = check, remember
        self._forget_all()

    def _forget_all(self) -> None:
        """A word that has a blank in front stands under its letters, another one behind NUL. A piece is up to three words: a line end, letters and marks; -1 where one is missing."""
        self.words: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0
        self.pieces: dict[str, int] = {}
        self.parts = np.full((1 << 16, 3), -1, dtype=np.int32)
        self.safe = np.zeros((1 << 16, 2), dtype=bool)  # whether its first and last character are
        self.uses = np.zeros(1 << 16, dtype=np.int64)

    def _keep_used(self, words: bool) -> None:
        """Keep the pieces that recurred, a quarter of ``remember`` at most; with ``words`` only their words."""
        keep = np.argsort(-self.uses[: len(self.pieces)], kind="stable")[: self.remember // 4]
        keep = np.sort(keep[self.uses[keep] > 1])
        names, parts, safe = list(self.pieces), self.parts[keep], self.safe[keep]
        n = len(keep)
        self.pieces = {names[i]: j for j, i in enumerate(keep.tolist())}
        self.parts[:n], self.safe[:n] = parts, safe
        self.uses[:] = 0
        if words:
            names, held = list(self.words), np.unique(parts[parts >= 0])
            self.words = {names[i]: j for j, i in enumerate(held.tolist())}
            self.parts[:n] = np.where(parts >= 0, np.searchsorted(held, parts), -1)
            length = self.length[held]
            ends = np.cumsum(length)
            self.used = int(length.sum())
            self.ids[: self.used] = self.ids[np.repeat(self.start[held] - ends + length, length) + np.arange(self.used)]
            self.start[: len(held)], self.length[: len(held)] = ends - length, length

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, new: list[str]) -> None:
        """``new`` are distinct words that are not known."""
        if not new:
            return
        if self.byte_level:
            plain, other = [], []
            for w in new:
                (plain if w.isalpha() and (w.isascii() or _IS_LATIN(w)) else other).append(w)
            rest = [w[1:] if w[:1] == "\0" else " " + w for w in other]
            new = plain + other
        elif self.folds and not self.blanks:  # such a model takes a folded ASCII word as it is
            plain, rest = [], []
            for w in new:
                (plain if w.isascii() and w.islower() and w.isalpha() else rest).append(w)
            new = plain + rest
        else:
            plain, rest = [], [w if not self.blanks else w[1:] if w[:1] == "\0" else " " + w for w in new]
        flat, length = self._together(plain)
        found = self._plain(rest)
        n, k = len(new), len(self.words)
        while k + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        length = np.concatenate([length, np.fromiter(map(len, found), dtype=np.int64, count=len(found))])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), dtype=np.uint32)])
        total = len(flat)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = flat
        self.start[k : k + n], self.length[k : k + n] = self.used + np.cumsum(length) - length, length
        self.words.update(zip(new, range(k, k + n)))
        self.used += total

    def _together(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of letters, and how many each has: many words in one text, told apart by the letters of the entries."""
        if not plain:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        lines = ["\n".join(plain[i : i + LINES]) for i in range(0, len(plain), LINES)]
        if self.byte_level:
            lines = [_letters(" " + x.replace("\n", "\n ")) for x in lines]
        flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.merger.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.cumsum(self.sizes[flat])
        borders = np.cumsum(np.fromiter(map(len, chain.from_iterable(x.split("\n") for x in lines)), dtype=np.int64, count=len(plain)))
        behind = np.searchsorted(ends, borders, side="right")
        if behind[-1] != len(flat) or (ends[behind - 1] != borders).any():
            raise ValueError("this tokenizer's entries are not the letters of its words")
        return flat, np.diff(behind, prepend=0)

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            self._learn_words(list(dict.fromkeys(unknown)))
            out[missing] = list(map(self.words.__getitem__, unknown))
        return out

    def _learn_pieces(self, keys: list[str]) -> None:
        """A key is a piece without the blank in front; one that begins with a line end, or with NUL for a text's head, stands for itself."""
        bare = "\0" if self.blanks else ""
        whole, cores, marks, rest = [], [], [], []
        for key in keys:
            if key.isalpha() and (key.isascii() or _IS_LATIN(key)):
                whole.append(key)
                continue
            core = key.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or _IS_LATIN(core)):
                cores.append(core)
                marks.append(key[len(core) :])
            else:
                rest.append(key)
        n, k = len(keys), len(self.pieces)
        while k + n > len(self.parts):
            self.parts, self.safe, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.parts, self.safe, self.uses))
        a, b = k + len(whole), k + len(whole) + len(cores)
        letters = whole + cores
        if self.folds and letters:
            letters = "\n".join(letters).lower().split("\n")
        self.parts[k : k + n] = -1
        self.uses[k : k + n] = 0
        self.parts[k:b, 1] = self._word_numbers(letters)
        self.parts[a:b, 2] = self._word_numbers([bare + m for m in marks])
        self.safe[k:b] = True
        lines, words, tails, safe = [], [], [], []
        for key in rest:
            sign = key[:1]
            core = key[1:].rstrip(MARKS) if sign == "\n" else ""
            if core.isalpha() and (core.isascii() or _IS_LATIN(core)):
                lines.append("\n")
                words.append(bare + (core.lower() if self.folds else core))
                tails.append(key[1 + len(core) :])
                safe.append((True, True))
            else:
                lines.append("")
                words.append(bare + key[1:] if sign == "\0" else bare + key if sign == "\n" else key if self.blanks else " " + key)
                tails.append("")
                safe.append((_IS_SAFE((key[1:] if sign == "\n" else key)[:1]) is not None, _IS_SAFE(key[-1:]) is not None))
        if rest:
            self.parts[b : k + n, 1] = self._word_numbers(words)
            for j, column in ((0, lines), (2, tails)):
                at = [i for i, w in enumerate(column, b) if w]
                self.parts[at, j] = self._word_numbers([bare + w for w in column if w])
            self.safe[b : k + n] = safe
        self.pieces.update(zip(whole, range(k, a)))
        self.pieces.update(zip(map(str.__add__, cores, marks), range(a, b)))
        self.pieces.update(zip(rest, range(b, k + n)))

    def _numbers(self, keys: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.pieces.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            unknown = [keys[i] for i in missing]
            self._learn_pieces(list(dict.fromkeys(unknown)))
            out[missing] = list(map(self.pieces.__getitem__, unknown))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more at the end)."""
        if max(len(self.words), len(self.pieces)) > self.remember:
            self._keep_used(len(self.words) > self.remember)
        split = [("\0" + t.replace("\n", " \n")).split(" ") for t in texts]
        count = np.fromiter(map(len, split), dtype=np.int64, count=len(texts))
        k = self._numbers(list(chain.from_iterable(split)))
        text = np.repeat(np.arange(len(texts)), count)
        heads = np.concatenate([[0], np.cumsum(count)])
        inner = np.ones(len(k), dtype=bool)
        inner[heads[:-1]] = False
        inner = np.flatnonzero(inner)
        odd = set(text[inner[~(self.safe[k[inner - 1], 1] & self.safe[k[inner], 0])]].tolist())
        odd.update(i for i, t in enumerate(texts) if " \n" in t or "\0" in t)
        if odd:
            pieces = [k[a:b] for a, b in zip(heads[:-1], heads[1:])]
            for i in odd:
                pieces[i] = self._numbers(["\0" + p for p in _CUT.split(texts[i])])
            count = np.fromiter(map(len, pieces), dtype=np.int64, count=len(texts))
            k = np.concatenate(pieces)
        self.uses[: len(self.pieces)] += np.bincount(k, minlength=len(self.pieces))
        parts = self.parts[k]
        word = parts[parts >= 0]
        length = self.length[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(self.start[word] - ends[:-1], length) + np.arange(ends[-1])]
        behind = np.concatenate([[0], np.cumsum((parts >= 0).sum(1))])  # words in front of each piece
        offsets = ends[behind[np.concatenate([[0], np.cumsum(count)])]]
        while self.check and len(texts):
            i = self.check % len(texts)
            self.check -= 1
            if self._plain([texts[i]])[0] != ids[offsets[i] : offsets[i + 1]].tolist():
                raise ValueError("this tokenizer does not split texts at blanks")
        return ids, offsets

    def encode_closed(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` behind each text."""
        ids, at = self.encode(texts)
        n = len(texts)
        out = np.full(len(ids) + n, end_id, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        return out, at + np.arange(n + 1)


def worker_encoder(path: str, remember: int = WORDS) -> PieceEncoder:
    """The encoder of this Python worker, which outlives its tasks: words learned in one serve the next."""
    return worker_state(("encoder", path, remember), lambda: PieceEncoder(path, remember=remember))
