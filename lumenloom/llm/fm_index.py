"""A compressed FM-index over sequences of symbols: the Burrows-Wheeler transform in a wavelet matrix.

Patterns are searched backwards, many at a time: each step asks the wavelet matrix for two ranks of
every pattern's next symbol. Bit vectors are packed, with one count for each 64 bits.
"""

from __future__ import annotations

import numpy as np

U8 = np.uint64


class BitVector:
    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="i4")[:-1]]).astype("i4")

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U8(1) << (i & 63).astype(U8)) - U8(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.vectors, self.zeros = [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((s >> level) & 1).astype(np.uint8)
            self.vectors.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            s = np.concatenate([s[bits == 0], s[bits == 1]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, "i8"))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (vector, zeros) in enumerate(zip(self.vectors, self.zeros)):
            ones = vector.rank(i)
            bit = (c >> (self.levels - 1 - k)) & 1
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        return self._walk(c, i) - self.first[c]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols at least, by prefix doubling; ties by position."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype("i8")
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        second = np.zeros(n, "i8")
        second[:-width] = rank[width:] + 1 if n > width else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, "i8")
        rank[order] = new
        width *= 2
        if new[-1] == n - 1:
            break
    return order


class FMIndex:
    """Counts occurrences of patterns of fewer than `depth` symbols. Symbol 0 separates sequences."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        order = sorted_suffixes(text, depth)
        self.n = len(text)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.matrix = WaveletMatrix(text[order - 1], sigma)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern for the intervals [lo, hi) of patterns."""
        both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.starts[c] + both[: len(c)], self.starts[c] + both[len(c) :]

    def longest_repeats(self, padded: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each row, how many symbols left of its end still form a sequence that occurs twice or more.

        padded: rows of symbols, of which only those before `ends` are read.
        """
        length = np.zeros(len(ends), "i8")
        alive = np.flatnonzero(ends > 0)
        lo, hi = np.zeros(len(ends), "i8"), np.full(len(ends), self.n, "i8")
        while len(alive):
            c = padded[alive, ends[alive] - 1 - length[alive]]
            new_lo, new_hi = self.extend(c, lo[alive], hi[alive])
            ok = new_hi - new_lo >= 2
            alive = alive[ok]
            lo[alive], hi[alive] = new_lo[ok], new_hi[ok]
            length[alive] += 1
            alive = alive[length[alive] < ends[alive]]
        return length
