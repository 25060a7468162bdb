"""A compressed FM-index over strings of whole numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols: one packed bit row with running counts for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.rows, self.ones_before, self.zeros = [], [], []
        values = values.astype(np.int64)
        for level in reversed(range(bits)):
            bit = (values >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            row = np.packbits(padded, bitorder="little").view("<u8")
            self.rows.append(row)
            self.ones_before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(row).astype(np.int64))[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the top row lands on the way of its symbol; landings differ by ranks."""
        at = at.copy()
        for level in range(self.bits):
            word = at >> 6
            below = self.rows[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones_before[level][word] + np.bitwise_count(below)
            bit = (symbols >> (self.bits - 1 - level)) & 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings that end in a 0 each; an earlier 0 counts as less than a later one.

    Prefix doubling: ranks of the first h symbols give those of the first 2 h.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    h = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1
        ahead[ends] = 0
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        h *= 2


class FMIndex:
    """Index over strings of symbols >= 1 that are joined with a 0 after each."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.suffixes = suffix_array(symbols)
        before = symbols[self.suffixes - 1]
        size = int(symbols.max()) + 1
        self.wavelet = WaveletMatrix(before, max(1, int(size - 1).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        every = np.arange(size)
        self.origin = self.wavelet.descend(every, np.zeros(size, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of each pattern with one more symbol at its left."""
        landed = self.wavelet.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.less[symbols] - self.origin[symbols]
        return landed[: len(symbols)] + start, landed[len(symbols) :] + start

    def statistics(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the piece of the stream that ends before each of `ends`: how far back, up to `most` symbols, it matches more
        than one place of the indexed strings, and the interval there (low, high) of the full length where it does."""
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = low.copy(), np.full(len(ends), self.n, np.int64)
        for step in range(most):
            at = ends[live] - 1 - step
            inside = at >= 0
            symbols = np.where(inside, stream[np.maximum(at, 0)], 0)
            if step == 0:
                lo, hi = self.less[symbols], self.less[symbols + 1]
            else:
                lo, hi = self.extend(symbols, lo, hi)
            keep = (symbols > 0) & (hi - lo > 1)
            live, lo, hi = live[keep], lo[keep], hi[keep]
            length[live] = step + 1
            if not len(live):
                break
        full = length[live] == most
        low[live[full]], high[live[full]] = lo[full], hi[full]
        return length, low, high
