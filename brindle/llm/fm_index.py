"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix of packed bits, and a sampled suffix array."""

from __future__ import annotations

import numpy as np


class PackedBits:
    """Bits with rank: 64-bit words and one count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The bit at each place."""
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Symbols of a sequence and their ranks, one row of packed bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        now, self.first = symbols, np.zeros(size, np.int64)
        names = np.arange(size)
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            ones = ((now >> bit) & 1).astype(bool)
            row = PackedBits(ones)
            zeros = len(now) - int(ones.sum())
            self.levels.append((bit, row, zeros))
            self.first = self._step(row, zeros, (names >> bit) & 1, self.first)
            now = np.concatenate([now[~ones], now[ones]])

    @staticmethod
    def _step(row: PackedBits, zeros: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = row.rank(i)
        return np.where(bit == 1, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for bit, row, zeros in self.levels:
            i = self._step(row, zeros, (symbol >> bit) & 1, i)
        return i - self.first[symbol]

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for bit, row, zeros in self.levels:
            one = row.get(i)
            symbol |= one << bit
            i = self._step(row, zeros, one, i)
        return symbol, i - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the text in the order of what follows, by prefix doubling."""
    n = len(text)
    rank, done = text.astype(np.int64), 1
    while True:
        next_ = np.zeros(n, np.int64)
        next_[: n - done] = rank[done:] + 1 if done < n else 0
        key = rank * (n + 2 + int(rank.max())) + next_
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        done *= 2
        if rank.max() == n - 1:
            return order


class FMIndex:
    """Backward search for many patterns at once. text: symbols from 1, and 0 between its pieces.

    Kept are the transform in a wavelet matrix, one count a symbol, and every sample-th place of the suffix array.
    """

    def __init__(self, text: np.ndarray, sample: int = 8):
        places = suffix_order(text)
        size = int(text.max()) + 1
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt = WaveletMatrix(text[places - 1], size)
        marked = places % sample == 0
        self.marks, self.sampled = PackedBits(marked), places[marked].astype(np.int32)

    def matches(self, text: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text at the places where matches end: length, and the interval of where the match stands.

        The match at a place is the longest that ends there and stands in the index more than once, up to most symbols.
        """
        length = np.zeros(len(at), np.int64)
        low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        which, q = np.arange(len(at)), at
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.counts[-1])
        for done in range(1, most + 1):
            c = text[q]
            lo, hi = self.counts[c] + self.bwt.rank(c, lo), self.counts[c] + self.bwt.rank(c, hi)
            more = (hi - lo > 1) & (c > 0)
            which, q, lo, hi = which[more], q[more] - 1, lo[more], hi[more]
            if not len(which):
                break
            length[which], low[which], high[which] = done, lo, hi
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array: steps to the symbol before, until a sampled one."""
        out, which, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(which):
            hit = self.marks.get(rows) == 1
            out[which[hit]] = self.sampled[self.marks.rank(rows[hit])] + steps
            which, rows = which[~hit], rows[~hit]
            symbol, before = self.bwt.get(rows)
            rows, steps = self.counts[symbol] + before, steps + 1
        return out
