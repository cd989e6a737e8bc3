"""FM-index over a sequence of numbers: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from contrail.llm.batches import spread


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, by prefix doubling."""
    n = len(values)
    rank, width = np.unique(values, return_inverse=True)[1].astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of any symbol in any prefix, one bit plane at a time."""

    def __init__(self, values: np.ndarray, top: int):
        self.planes, self.zeros = [], []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = values >> bit & 1
            self.planes.append((bit, np.r_[0, np.cumsum(ones)].astype(np.int32)))
            self.zeros.append(int(len(values) - ones.sum()))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``end``."""
        low, high = np.zeros_like(end), end
        for (bit, ones), zeros in zip(self.planes, self.zeros):
            one = (symbol >> bit & 1) == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for (bit, ones), zeros in zip(self.planes, self.zeros):
            one = ones[at + 1] - ones[at]
            value |= one.astype(np.int64) << bit
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return value


class FMIndex:
    """Index of a sequence of positive numbers; every ``step``-th position is kept for locating."""

    def __init__(self, values: np.ndarray, step: int = 8):
        text = np.r_[values, 0]  # 0: the end, before everything else
        order = suffix_array(text)
        self.n, self.step = len(text), step
        top = int(text.max())
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.last = WaveletMatrix(text[order - 1], top)
        kept = order % step == 0
        self.kept, self.kept_before, self.positions = kept, np.cumsum(kept) - kept, order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (one a row, from column 0), read backwards from their ends."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for back in range(patterns.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - back]
            known = symbol < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = (self.before[symbol] + self.last.rank(symbol, x[live]) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a kept position is met."""
        rows, at, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.kept[rows[todo]]
            done = todo[there]
            at[done] = self.positions[self.kept_before[rows[done]]] + steps[done]
            todo = todo[~there]
            symbol = self.last.access(rows[todo])
            rows[todo] = self.before[symbol] + self.last.rank(symbol, rows[todo])
            steps[todo] += 1
        return at

    def occurrences(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern number and position of every occurrence."""
        low, high = self.search(patterns, lengths)
        return np.repeat(np.arange(len(patterns)), high - low), self.locate(spread(low, high - low))
