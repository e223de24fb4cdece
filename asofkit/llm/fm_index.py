"""An FM-index over a shard of symbols, in numpy: suffix order, wavelet ranks, backward search, sampled positions.

The text is a row of symbols in which 0 is a separator. Every separator counts as smaller than all other symbols and as
different from the other separators, so no match runs across one and suffixes differ at the next separator at latest.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in sorted order, by doubling; only groups that are still tied are sorted again.

    The last symbol must be a separator.
    """
    n = len(text)
    n_separators = int((text == 0).sum())
    key = text + n_separators
    key[text == 0] = np.arange(n_separators)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    begins = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    alone = begins & np.concatenate((begins[1:], [True]))
    slots, width = np.flatnonzero(~alone), 1
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        alone = begins & np.concatenate((begins[1:], [True]))
        slots, width = slots[~alone], width * 2
    return order


class WaveletRanks:
    """Symbols by bit planes; each plane keeps the running count of ones, which answers rank and access."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[~bit], current[bit]))
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            up = ones[place]
            place = np.where(bit, zeros + up, place - up)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, place) - self.start[symbol]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol = np.zeros(len(place), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            up = ones[place]
            bit = ones[place + 1] != up
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + up, place - up)
        return symbol, place - self.start[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        text = np.asarray(text, dtype=np.int64)
        order = suffix_order(text)
        self.ranks = WaveletRanks(text[order - 1], n_symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:-1]
        # kept: every sample-th place, and each place after a separator, where walking back must end
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept_place = order[kept]
        self.kept = kept

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all phrases at once; row i holds its symbols in the first lengths[i] columns."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), len(self.kept), dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((column < lengths) & (low < high))
            symbol = phrases[on, column]
            low[on] = self.before[symbol] + self.ranks.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.ranks.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back until a kept suffix, then add the steps."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.kept[at])
        while len(walking):
            symbol, rank = self.ranks.access(at[walking])
            at[walking] = self.before[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.kept[at[walking]]]
        return self.kept_place[self.kept_before[at]] + steps
