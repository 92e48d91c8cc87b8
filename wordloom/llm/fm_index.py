"""FM-index over word ids: suffix order, wavelet ranks, backward search, sampled positions.

The indexed text is a row of symbols: 0 ends a run of words, 1 and above are words. Every end mark
counts as a symbol of its own, ordered by place, so that no match goes beyond a run.
"""

from __future__ import annotations

import numpy as np

SAMPLED_EVERY = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes in ascending order, by doubling the length that is already ordered."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank[order[-1]] == n - 1:
            return order
        length *= 2


class BitRank:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols, one bit per level from the highest; each level keeps zeros in front of ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, values = [], symbols
        for level in range(self.bits - 1, -1, -1):
            bits = (values >> level) & 1 == 1
            self.levels.append(BitRank(bits))
            values = np.concatenate([values[~bits], values[bits]])
        self.firsts = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ranks in enumerate(self.levels):
            ones = ranks.ones(at)
            right = (symbols >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(right, ranks.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of its place."""
        return self._descend(symbols, at) - self.firsts[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbols = np.zeros(len(at), np.int64)
        for ranks in self.levels:
            ones, right = ranks.ones(at), ranks.get(at)
            symbols = symbols * 2 + right
            at = np.where(right, ranks.zeros + ones, at - ones)
        return symbols, at - self.firsts[symbols]


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        """``symbols``: end marks 0 and words below ``n_symbols``; the last one is an end mark."""
        self.size = len(symbols)
        order = suffix_order(symbols)
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64), n_symbols)
        counts = np.bincount(symbols, minlength=n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        # A place is sampled every few words and at the start of a run: a walk backwards ends there.
        starts = np.concatenate([[True], symbols[:-1] == 0])
        sampled = (starts | (np.arange(self.size) % SAMPLED_EVERY == 0))[order]
        self.sampled = BitRank(sampled)
        self.places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one row of the suffixes that begin with each phrase.

        ``phrases``: one per row, aligned to the right; ``lengths``: their words.
        """
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            word = phrases[live, width - 1 - step]
            low[live] = self.smaller[word] + self.tree.rank(word, low[live])
            high[live] = self.smaller[word] + self.tree.rank(word, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows stand in the text."""
        found, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled.get(rows[left])
            done = left[known]
            found[done] = self.places[self.sampled.ones(rows[done])] + steps
            left = left[~known]
            symbols, ranks = self.tree.access(rows[left])
            rows[left] = self.smaller[symbols] + ranks
            steps += 1
        return found
