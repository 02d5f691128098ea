"""A compressed FM-index over sequences of integers, with vectorised backward search and matching statistics.

The index holds the Burrows-Wheeler transform as a wavelet matrix (one bit vector for each bit of a symbol, packed into 64-bit words
with a running count beside each word), and for each row, in a byte, how many symbols it shares with the row before. Suffixes are
sorted by their first symbols only, as many as patterns can have; suffix array and ranks are gone once the index is built.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Wavelet matrix: packed bits and ranks for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = []
        s = symbols
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((s >> shift) & 1).astype(bool)
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            words.view(np.uint8)[: (self.n + 7) >> 3] = np.packbits(bit, bitorder="little")
            ranks = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ranks[1:])
            self.levels.append((shift, words, ranks, int(self.n - bit.sum())))
            s = np.concatenate((s[~bit], s[bit]))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` entries end in the order of the last level, going down by each symbol's bits."""
        for shift, words, ranks, zeros in self.levels:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = ranks[block] + np.bitwise_count(words[block] & below)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of symbols 1 .. sigma - 1. ``depth`` symbols (up to 63) decide the order of suffixes, so patterns of fewer than
    ``depth`` symbols can be searched. ``locate`` keeps the suffix array in ``rows``."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, locate: bool = False):
        n = len(text)
        rank, have = text.astype(np.int32), 1
        ranks = {1: rank}
        while have < depth:
            step = min(have, depth - have)
            rank = self.joined(rank, step)
            have += step
            if step == have - step:
                ranks[have] = rank
        rows = np.argsort(rank, kind="stable")
        self.bwt = Wavelet(text[rows - 1], sigma)
        before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        every = np.arange(sigma)
        self.base = before - self.bwt.place(every, np.zeros(sigma, np.int64))
        self.n = n
        #: Symbols that row i shares with row i - 1; -1 at both ends.
        self.shared = np.full(n + 1, -1, np.int8)
        one, two, same = rows[:-1], rows[1:], np.zeros(max(n - 1, 0), np.int64)
        for size in sorted(ranks, reverse=True):
            padded = np.append(ranks[size], np.int32(-1))
            same += size * (padded[np.minimum(one + same, n)] == padded[np.minimum(two + same, n)])
        self.shared[1:n] = np.minimum(same, depth)
        self.edges: dict[int, np.ndarray] = {}
        if locate:
            self.rows = rows

    @staticmethod
    def joined(rank: np.ndarray, step: int) -> np.ndarray:
        """Rank by twice as many symbols: that of a place and that of the place ``step`` later (0 beyond the end)."""
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(later.max(initial=0)) + 1) + later
        return np.unique(key, return_inverse=True)[1].astype(np.int32)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows of the patterns with one more symbol on the left."""
        both = self.bwt.place(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        base = self.base[symbols]
        return base + both[: len(lo)], base + both[len(lo) :]

    def widened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider interval of each: the rows that share all but some last symbols of the pattern, and how many are left."""
        left = np.maximum(np.maximum(self.shared[lo], self.shared[hi]), 0).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for size in np.unique(left).tolist():
            at = left == size
            if not size:
                lo[at], hi[at] = 0, self.n
                continue
            if size not in self.edges:
                self.edges[size] = np.flatnonzero(self.shared < size)
            edges = self.edges[size]
            lo[at] = edges[np.searchsorted(edges, lo[at], "right") - 1]
            hi[at] = edges[np.searchsorted(edges, hi[at], "left")]
        return lo, hi, left

    def statistics(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Matching statistics of some texts (places ``first``, lengths ``size``, none longer than patterns may be): for each place the
        length of the longest pattern from there on that the index has. Symbols that the index lacks are 0."""
        out = np.zeros(len(text), np.uint8)
        order = np.argsort(-size, kind="stable")
        end, size = (first + size)[order], size[order]
        lo, hi, have = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):  # all texts that are long enough, one symbol further to the left
            live = int(np.searchsorted(-size, -step, "right"))
            lo, hi, have = lo[:live], hi[:live], have[:live]
            place = end[:live] - step
            todo = np.arange(live)
            while len(todo):
                symbol = text[place[todo]]
                a, b = self.extend(symbol, lo[todo], hi[todo])
                fits = (a < b) & (symbol > 0)
                done = todo[fits]
                lo[done], hi[done] = a[fits], b[fits]
                have[done] += 1
                todo = todo[~fits]
                todo = todo[have[todo] > 0]  # at the root the symbol isn't there at all
                if len(todo):
                    lo[todo], hi[todo], have[todo] = self.widened(lo[todo], hi[todo])
            out[place] = have
        return out
