"""An FM-index over integer symbols in numpy: wavelet matrix ranks, backward search, sampled suffix positions.

Texts are sequences of symbols 1..size-1; symbol 0 separates stretches and never occurs in a phrase.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is made distinct, so no comparison runs past a separator."""
    n = len(text)
    gaps = text == 0
    n_gaps = int(gaps.sum())
    rank = text.astype(np.int64) + n_gaps
    rank[gaps] = np.arange(n_gaps)
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h = 1
    while True:
        ranked = rank[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if new.all():
            return order
        # Only suffixes that still tie with a neighbour are sorted again, by the rank h symbols further on.
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        members = order[where]
        ahead = members + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[members]
        again = np.argsort(first * np.int64(n + 1) + second, kind="stable")
        order[where] = members[again]
        first, second = first[again], second[again]
        changed = np.ones(len(where), dtype=bool)
        changed[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        # Ranks are positions of the first of equals, so untouched suffixes keep theirs.
        heads = np.maximum.accumulate(np.where(changed, where, 0))
        if h == 1:
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = starts
        rank[order[where]] = heads
        h *= 2


class WaveletMatrix:
    """rank(symbol, position) for many positions at once, one bit plane per level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.planes, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            ones = ((now >> level) & 1).astype(bool)
            before = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:], dtype=np.int32)
            self.planes.append(before)
            self.zeros.append(int(len(now) - before[-1]))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, at = np.zeros_like(positions), positions.copy()
        for i, before in enumerate(self.planes):
            ones = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            start = np.where(ones, self.zeros[i] + before[start], start - before[start])
            at = np.where(ones, self.zeros[i] + before[at], at - before[at])
        return at - start

    def symbols(self, positions: np.ndarray) -> np.ndarray:
        at, out = positions.copy(), np.zeros(len(positions), dtype=np.int64)
        for i, before in enumerate(self.planes):
            ones = before[at + 1] > before[at]
            out = out * 2 + ones
            at = np.where(ones, self.zeros[i] + before[at], at - before[at])
        return out


class FMIndex:
    """Index of one shard. Every ``sample``-th text position is kept; the others are reached by walking backward."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8) -> None:
        # Separators at both ends give every walk a sampled end.
        self.text = np.concatenate([[0], text, [0]]).astype(np.int64)
        n = len(self.text)
        order = suffix_array(self.text)
        self.last = self.text[order - 1]  # the Burrows-Wheeler transform
        self.bits = max(1, int(size - 1).bit_length())
        self.wavelet = WaveletMatrix(self.last, self.bits)
        counts = np.bincount(self.text, minlength=size + 1)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        # Positions after a separator are kept too: separators are ordered by place, so no walk may step over one.
        keep = (order % sample == 0) | (self.last == 0)
        self.sampled = keep
        self.sample_rank = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
        self.positions = order[keep]
        self.n = n

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each phrase; all phrases step backward together."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        longest = max((len(p) for p in phrases), default=0)
        steps = np.zeros((len(phrases), longest), dtype=np.int64)
        for i, p in enumerate(phrases):
            steps[i, : len(p)] = p[::-1]
        lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        for k in range(longest):
            on = np.flatnonzero((lengths > k) & (low < high))
            if not len(on):
                break
            c = steps[on, k]
            low[on] = self.below[c] + self.wavelet.rank(c, low[on])
            high[on] = self.below[c] + self.wavelet.rank(c, high[on])
        return low, high

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by rank, in the text as it was passed in."""
        at, walked = ranks.copy(), np.zeros(len(ranks), dtype=np.int64)
        out = np.full(len(ranks), -1, dtype=np.int64)
        todo = np.arange(len(ranks))
        while len(todo):
            known = self.sampled[at[todo]]
            hit = todo[known]
            out[hit] = self.positions[self.sample_rank[at[hit]]] + walked[hit]
            todo = todo[~known]
            if len(todo):
                c = self.wavelet.symbols(at[todo])
                at[todo] = self.below[c] + self.wavelet.rank(c, at[todo])
                walked[todo] += 1
        return out - 1
