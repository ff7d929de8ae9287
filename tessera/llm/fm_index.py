"""FM-index of a shard's words in NumPy: suffix array by doubling, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many text positions, a suffix-array entry is kept; locating walks back to the next one.
SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of text by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    key = text[order]
    # a rank is the first place of its group, so groups keep their ranks while others are refined
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.empty(0, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    size = np.diff(np.r_[first, n])
    tied = np.repeat(size > 1, size)
    step = 1
    while tied.any():
        at = np.flatnonzero(tied)
        rows = order[at]
        group = rank[rows]
        after = rank[np.minimum(rows + step, n)]
        by = np.lexsort((after, group))
        rows, group, after = rows[by], group[by], after[by]
        order[at] = rows
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(rows)])
        rank[rows] = np.repeat(at[starts], size)
        tied[:] = False
        tied[at] = np.repeat(size > 1, size)
        step *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in any prefix: one bit vector a level, with running counts of its set bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        now = symbols.astype(np.int64)
        for k in range(self.levels - 1, -1, -1):
            bit = (now >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `end` symbols."""
        lo, hi = np.zeros_like(end), end
        for k, zeros, ones in zip(range(self.levels - 1, -1, -1), self.zeros, self.ones, strict=True):
            up = ((symbol >> k) & 1).astype(bool)
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            hi = np.where(up, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for zeros, ones in zip(self.zeros, self.ones, strict=True):
            up = ones[at + 1] - ones[at]
            symbol = symbol * 2 + up
            at = np.where(up == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of a text of symbols 0 .. sigma-1; symbol 0 separates runs and is in no pattern."""

    def __init__(self, text: np.ndarray, sigma: int):
        text, sigma = np.append(np.asarray(text, np.int64) + 1, 0), sigma + 1  # one end mark, less than all symbols
        n = len(text)
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], sigma)  # before the first symbol comes the end mark
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        kept = order % SAMPLE_EVERY == 0
        self.kept = kept
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.position = order[kept]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns, all at once: the range of suffixes that begin with each."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = patterns[live, j] + 1
            lo[live] = self.less[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.less[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back until a sampled row."""
        found = np.full(len(row), -1, np.int64)
        row, steps = row.copy(), 0
        open_ = np.arange(len(row))
        while len(open_):
            at = row[open_]
            done = self.kept[at]
            found[open_[done]] = self.position[self.kept_before[at[done]]] + steps
            open_ = open_[~done]
            at = row[open_]
            c = self.bwt.access(at)
            row[open_] = self.less[c] + self.bwt.rank(c, at)
            steps += 1
        return found
