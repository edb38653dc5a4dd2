"""Tokenizer files and a worker's memo of encoded pieces.

A byte-level or word tokenizer never merges across white space, so a text is the
concatenation of its pieces' encodings. Pieces repeat; a worker encodes each piece once
with the tokenizers library and looks it up afterwards.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

_KEEP = 400_000  # pieces that a worker keeps, about 90 MB; it forgets when half full
_ASCII_SPACE = " \\t\\n\\r\\x0b\\x0c"
#: White space to Unicode and to the tokenizers, but not in the ASCII class above.
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A run of spaces with the word behind it: no pattern of the byte-level kind crosses into the next.
_PIECE = re.compile(f"[{_ASCII_SPACE}]*[^{_ASCII_SPACE}]+|[{_ASCII_SPACE}]+")


def public_path(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


#: ASCII signs that no pattern joins to a letter before them, and that no special string begins or ends with.
_SIGNS = ".,!?;:$%&*#"


class _Slots(dict):
    """piece -> its number; asking for an unknown piece numbers it and notes it as new."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, piece) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Pieces:
    """Encodes texts by their pieces.

    ``spaced``: white space is part of a token (byte-level), so a piece is a run of
    spaces and its word; else pieces are words between ASCII spaces.
    """

    def __init__(self, path: str, spaced: bool):
        self.own, self.spaced = tokenizer(path), spaced
        self._clear()

    def _clear(self) -> None:
        self.slot = _Slots()
        self.start, self.size, self.uses = (np.zeros(_KEEP + 1, np.int64) for _ in range(3))
        self.pool, self.filled = np.zeros(_KEEP * 4, np.int32), 0

    def _evict(self) -> None:
        """Forget the pieces met once; all of them if most were met more often."""
        old, start, size, uses, pool = self.slot, self.start, self.size, self.uses, self.pool
        kept = [(piece, i) for piece, i in old.items() if uses[i] > 1]
        self._clear()
        if len(kept) < _KEEP // 4:
            was = np.array([i for _, i in kept], np.int64)
            for piece, _ in kept:
                self.slot[piece]
            self.slot.new.clear()
            self._put(np.arange(len(kept)), size[was], _gathered(pool, start[was], size[was]))

    def _put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Store the ids of several pieces, which stand one behind the other."""
        while len(self.slot) > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.filled += len(ids)

    def _learn(self) -> None:
        """Encode the new pieces; a word with signs behind it is the word and the signs."""
        new, self.slot.new = self.slot.new, []
        parts, signs = [], _SIGNS if self.spaced else _SIGNS.encode()
        for piece in new:
            word = piece.rstrip(signs)
            last = word[-1:] if self.spaced else word[-4:].decode(errors="ignore")[-1:]
            if len(word) < len(piece) and last.isalpha():
                parts.append((self.slot[piece], self.slot[word], self.slot[piece[len(word) :]]))
        whole = {n for n, _, _ in parts}
        asked = [x for x in new if self.slot[x] not in whole] + self.slot.new
        self.slot.new = []
        codes = [c.ids for c in self.own.encode_batch_fast([x if self.spaced else x.decode() for x in asked], add_special_tokens=False)]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        numbers = np.fromiter(map(self.slot.__getitem__, asked), np.int64, len(asked))
        self._put(numbers, sizes, np.fromiter(chain.from_iterable(codes), np.int32, int(sizes.sum())))
        if parts:
            n, word, tail = np.array(parts, np.int64).T
            both = np.stack([word, tail], axis=1).ravel()
            self._put(n, self.size[word] + self.size[tail], _gathered(self.pool, self.start[both], self.size[both]))

    def _split(self, text: str) -> list:
        if not self.spaced:
            return text.encode().split()
        if not text.isascii() and _OTHER_SPACE.search(text):
            return [text]
        return _PIECE.findall(text)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces in order, and how many each text has."""
        if len(self.slot) > _KEEP // 2:
            self._evict()
        split = [self._split(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        if self.slot.new:
            self._learn()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers, lengths

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        numbers, lengths = self._numbers(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[numbers])])
        at = np.concatenate([[0], np.cumsum(lengths)])
        return (ends[at[1:]] - ends[at[:-1]]).tolist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin (and the last's end)."""
        numbers, lengths = self._numbers(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[numbers])])
        return _gathered(self.pool, self.start[numbers], self.size[numbers]), ends[np.concatenate([[0], np.cumsum(lengths)])]


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` at ``start`` of ``size``, one behind the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
