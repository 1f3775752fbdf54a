"""Elias-Fano sequences and the n-gram trie built from them, in memory-mapped files."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_ONE = np.uint64(1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with ``rank`` ones before it in each 64-bit word."""
    place = np.zeros(len(word), np.int64)
    word, rank = word.copy(), rank.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = _popcount(word & np.uint64((1 << width) - 1))
        up = rank >= ones
        rank = np.where(up, rank - ones, rank)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), word)
    return place


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, ones counted per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @staticmethod
    def encode(values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """Header and sections of the sequence."""
        values = values.astype(np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            part = values & np.uint64((1 << bits) - 1)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        up = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(up[-1]) if n else 0) // 64 + 2
        flags = np.zeros(size * 64, np.uint8)
        flags[up] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = _popcount(high)
        ones = np.concatenate(([0], np.cumsum(count)))
        zeros = np.arange(size + 1) * 64 - ones
        return [n, bits], [low, high, ones, zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._low(i)

    def _first_at(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``bucket``: the ones before the bucket's first place."""
        bucket = np.minimum(bucket, int(self.zeros[-1]))
        before = np.maximum(bucket - 1, 0)  # the zero that ends the bucket before
        word = np.minimum(np.searchsorted(self.zeros, before, "right") - 1, len(self.high) - 1)
        place = word * 64 + _select_in_word(~self.high[word], before - self.zeros[word])
        return np.where(bucket > 0, np.minimum(place - before, self.n), 0)

    def successor(self, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and value of the first element >= target in low..high-1 (index ``high``, value -1 if there is none)."""
        bucket = target >> self.low_bits
        at = np.maximum(low, self._first_at(bucket))
        stop = np.minimum(high, self._first_at(bucket + 1))
        # binary search over the low bits of one bucket; what follows the bucket is larger
        wanted = target & ((1 << self.low_bits) - 1)
        left, right = at.copy(), np.maximum(at, stop)
        while True:
            open_ = left < right
            if not open_.any():
                break
            middle = (left + right) >> 1
            smaller = np.zeros(len(left), bool)
            smaller[open_] = self._low(middle[open_]) < wanted[open_]
            left = np.where(open_ & smaller, middle + 1, left)
            right = np.where(open_ & ~smaller, middle, right)
        left = np.minimum(left, high)
        value = np.full(len(left), -1, np.int64)
        inside = left < high
        value[inside] = self.get(left[inside])
        return left, value


class Codebook:
    """Values in equal steps between the least and the largest, as 16-bit codes."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[list[float], np.ndarray]:
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        return [low, step], np.round((values - low) / step).astype(np.uint16)


class Trie:
    """Two levels of an n-gram trie in one memory-mapped file: words, and under each the words before it.

    vocabulary   Elias-Fano over the hashes of the preceding words
    words        Elias-Fano over the hashes of the words
    pointers     Elias-Fano over the first child of each word
    children     Elias-Fano over base + vocabulary number of each child, where a word's base is the
                 number of vocabulary entries times its place: relative to the word, found by successor search
    codes        quantised log probabilities of both levels
    """

    PARTS = ("vocabulary", "words", "pointers", "children")

    def __init__(self, words: np.ndarray, word_log: np.ndarray, first: np.ndarray, before: np.ndarray, pair_log: np.ndarray):
        """``words`` ascending; children of word i are first[i]..first[i+1]-1 with ascending ``before``."""
        vocabulary = np.unique(before)
        self.width = max(1, len(vocabulary))
        counts = np.diff(first)
        children = np.repeat(np.arange(len(words), dtype=np.int64), counts) * self.width + np.searchsorted(vocabulary, before)
        self.file = tempfile.TemporaryFile()  # has no name, so nothing of it stays behind
        sections, at = {}, 0
        for name, values in zip(self.PARTS, (vocabulary, words, first, children), strict=True):
            head, arrays = EliasFano.encode(values)
            sections[name] = (head, [])
            for a in arrays:
                self.file.write(np.ascontiguousarray(a).tobytes())
                sections[name][1].append((a.dtype, at, len(a)))
                at += a.nbytes
        self.books, codes = [], []
        for values in (word_log, pair_log):
            book, code = Codebook.encode(values)
            self.books.append(book)
            self.file.write(code.tobytes())
            codes.append((code.dtype, at, len(code)))
            at += code.nbytes
        self.file.flush()
        self.bytes = at
        self.map = mmap.mmap(self.file.fileno(), max(1, at), access=mmap.ACCESS_READ) if at else b""
        view = lambda d, o, n: np.frombuffer(self.map, d, n, o)
        for name, (head, parts) in sections.items():
            setattr(self, name, EliasFano(*head, *(view(*p) for p in parts)))
        self.codes = [view(*c) for c in codes]

    def _find(self, sequence: EliasFano, wanted: np.ndarray) -> np.ndarray:
        at, value = sequence.successor(wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), sequence.n, np.int64))
        return np.where(value == wanted, at, -1)

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if unknown."""
        return self._find(self.words, hashes)

    def context(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each preceding word, -1 if unknown."""
        return self._find(self.vocabulary, hashes)

    def pair(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Place of (word, preceding word) among the children, -1 if unseen: successor of base + context in the word's range."""
        found = np.full(len(word), -1, np.int64)
        known = np.nonzero((word >= 0) & (context >= 0))[0]
        if len(known):
            w = word[known]
            target = w * self.width + context[known]
            at, value = self.children.successor(target, self.pointers.get(w), self.pointers.get(w + 1))
            found[known] = np.where(value == target, at, -1)
        return found

    def log(self, level: int, at: np.ndarray) -> np.ndarray:
        low, step = self.books[level]
        return low + step * self.codes[level][at]
