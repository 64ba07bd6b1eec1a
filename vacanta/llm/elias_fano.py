"""Elias-Fano coding of monotone sequences, and the levels of an n-gram trie made of them."""

from __future__ import annotations

import tempfile
from functools import cached_property

import numpy as np

_U = np.uint64


class EliasFano:
    """A monotone sequence of integers: low bits in whole bytes, high bits in unary, with rank marks.

    Built in numpy, written to a file of its own and mapped from there; queries are batched.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        self.low_bytes = min(7, -(-bits // 8))
        shift = _U(8 * self.low_bytes)
        values = values.astype(_U)
        low = np.empty((n, self.low_bytes), np.uint8)
        for k in range(self.low_bytes):
            low[:, k] = (values >> _U(8 * k)).astype(np.uint8)
        high = (values >> shift).astype(np.int64)
        size = int(universe >> (8 * self.low_bytes)) + n + 2
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[high + np.arange(n)] = 1
        words = np.packbits(marks, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        self._file = tempfile.TemporaryFile()  # gone with this object
        self._parts = {}
        for name, part in (("low", low), ("words", words), ("zeros", zeros.astype(np.int64))):
            self._parts[name] = (self._file.tell(), part.dtype, part.shape)
            self._file.write(part.tobytes())
        self._file.flush()
        self.low, self.words, self.zeros = (self._map(name) for name in ("low", "words", "zeros"))
        self.highest = size - n - 1

    def _map(self, name: str) -> np.ndarray:
        at, kind, shape = self._parts[name]
        if not np.prod(shape):
            return np.zeros(shape, kind)
        return np.memmap(self._file, kind, "r", at, shape)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.words.nbytes + self.zeros.nbytes

    @cached_property
    def _ends(self) -> np.ndarray:
        """How many values have a high part of at most each: the ones before that zero.

        Batches are about as long as the sequence, so all zeros are looked up once.
        """
        marks = np.unpackbits(self.words.view(np.uint8), bitorder="little")
        zeros = np.flatnonzero(marks == 0)[: self.highest + 1]
        return zeros - np.arange(len(zeros))

    @cached_property
    def _lows(self) -> np.ndarray:
        """Low parts as integers."""
        out = np.zeros(self.n, _U)
        for k in range(self.low_bytes):
            out |= self.low[:, k].astype(_U) << _U(8 * k)
        return out

    def values(self, index: np.ndarray) -> np.ndarray:
        """Low parts at the given indices."""
        return self._lows[index]

    def _search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index whose value is not below each wanted one, and the end of the run of its high part."""
        high = np.minimum((wanted >> _U(8 * self.low_bytes)).astype(np.int64), self.highest - 1)
        end = self._ends[high]
        start = np.where(high > 0, self._ends[np.maximum(high - 1, 0)], 0)
        rest = wanted & _U((1 << (8 * self.low_bytes)) - 1)
        low, up = start, end.copy()
        while True:
            open_ = np.flatnonzero(low < up)
            if not len(open_):
                return low, end
            middle = (low[open_] + up[open_]) >> 1
            below = self.values(middle) < rest[open_]
            low[open_[below]] = middle[below] + 1
            up[open_[~below]] = middle[~below]

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first value not below each wanted one; n where there is none."""
        return self._search(wanted.astype(_U))[0]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, -1 where it does not occur."""
        if not self.n:
            return np.full(len(wanted), -1, np.int64)
        wanted = wanted.astype(_U)
        at, end = self._search(wanted)
        inside = np.minimum(at, self.n - 1)
        same = self.values(inside) == (wanted & _U((1 << (8 * self.low_bytes)) - 1))
        return np.where((at < end) & same & ((wanted >> _U(8 * self.low_bytes)) < _U(self.highest)), inside, -1)


class TrieLevel:
    """Successors of contexts: where each context's begin, and their words relative to the context.

    A successor's word counts from its context's place times the number of words, so the whole level is
    one monotone sequence, and a query is a search for the successor of (context's place, word).
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray, n_words: int):
        """context, word: sorted pairs; code: their quantised probabilities."""
        self.n_words = max(int(n_words), 1)
        first = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        names = context[first]
        self.contexts = EliasFano(names, int(names[-1]) + 1 if len(names) else 1)
        place = np.cumsum(first) - 1
        self.words = EliasFano(place * np.int64(self.n_words) + word, max(len(names), 1) * self.n_words)
        self.code = code

    def find(self, context: np.ndarray, successors: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each (context, word), -1 where it does not occur; ``successors`` words belong to each context."""
        place = np.repeat(self.contexts.find(context), successors)
        at = self.words.find(np.maximum(place, 0) * np.int64(self.n_words) + word)
        return np.where(place >= 0, at, -1)
