"""Pair merging over ragged numpy arrays: a lookup of mergeable pairs and two ways to apply it."""

from __future__ import annotations

import heapq
from itertools import repeat

import numpy as np

NONE = np.int64(1) << 30  # above every rank
EMPTY = np.int64(-1)


class PairTable:
    """Open hash table from a pair of symbols to its rank (lower merges first) and the merged symbol."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rank, self.merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)
        self.bits = max(10, int(len(left)).bit_length() + 3)
        self.keys = np.full(1 << self.bits, EMPTY)
        self.entry = np.zeros(1 << self.bits, np.int32)
        key = left << 32 | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot] == EMPTY
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.entry[slot[put]] = key[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], slot[rest] + 1 & self.keys.size - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Entry numbers of the pairs, -1 where a pair doesn't merge. Negative symbols never merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        there = self.keys[slot]
        found = np.where((there == key) & (left >= 0) & (right >= 0), self.entry[slot], np.int32(-1))
        open_ = np.flatnonzero((there != key) & (there != EMPTY))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.keys.size - 1
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            found[open_[hit]] = self.entry[slot[open_[hit]]]
            open_ = open_[~hit & (there != EMPTY)]
        found[(left < 0) | (right < 0)] = -1
        return found


class Memo:
    """What was found for strings seen before in this worker: a ragged array by string, of bounded size."""

    def __init__(self, most: int = 300_000):
        self.most, self.row = most, {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, strings: list[str], compute) -> np.ndarray:
        """Row of each of the different ``strings``; ``compute`` gives (flat, counts) for new ones."""
        found = np.fromiter(map(self.row.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(found < 0)
        if len(self.row) + len(new) > self.most:
            self.__init__(self.most)
            found, new = np.full(len(strings), -1), np.arange(len(strings))
        if len(new):
            fresh = [strings[i] for i in new.tolist()]
            flat, counts = compute(fresh)
            found[new] = np.arange(len(self.counts), len(self.counts) + len(new))
            self.row.update(zip(fresh, found[new].tolist()))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
            self.counts = np.r_[self.counts, counts]
            self.flat = np.r_[self.flat, flat.astype(np.int32)]
        return found


def _pairs(table: PairTable, symbols: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry = np.full(len(symbols), -1, np.int32)
    inside = np.flatnonzero(seg[1:] == seg[:-1])
    entry[inside] = table.find(symbols[inside], symbols[inside + 1])
    return entry, np.where(entry >= 0, table.rank[entry], NONE)


def merge(table: PairTable, symbols: np.ndarray, lengths: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Merge each sequence until no pair of it merges; returns the symbols left and their count by sequence.

    A round pops the best pair of every sequence at once: all its occurrences (``every``), or the
    leftmost one only. The first is right where a merge never makes a pair that ranks before it.
    """
    symbols = symbols.astype(np.int32)
    seg = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    entry, rank = _pairs(table, symbols, seg)
    done_seg, done_symbols = [], []
    while len(seg):
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sizes = np.diff(np.r_[starts, len(seg)])
        best = np.minimum.reduceat(rank << 32 | np.arange(len(seg)), starts)
        live = best < NONE << 32
        if not live.all():
            over = np.repeat(~live, sizes)
            done_seg.append(seg[over])
            done_symbols.append(symbols[over])
            symbols, seg, entry, rank = (x[~over] for x in (symbols, seg, entry, rank))
            if not len(seg):
                break
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(seg)])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(seg)), starts)
        if every:
            at = np.flatnonzero(rank == np.repeat(best >> 32, sizes))
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])  # overlapping pairs: every second one
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) & 1
            at = at[odd == 0]
        else:
            at = best & 0xFFFFFFFF
        symbols[at] = table.merged[entry[at]]
        kept = np.ones(len(seg), bool)
        kept[at + 1] = False
        moved = np.cumsum(kept) - 1
        symbols, seg, entry, rank = (x[kept] for x in (symbols, seg, entry, rank))
        at = moved[at]
        redo = np.concatenate([at, at[at > 0] - 1])
        entry[redo], rank[redo] = -1, NONE
        redo = redo[redo < len(seg) - 1]
        redo = redo[seg[redo] == seg[redo + 1]]
        found = table.find(symbols[redo], symbols[redo + 1])
        entry[redo] = found
        rank[redo] = np.where(found >= 0, table.rank[found], NONE)
    if not done_seg:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    segs, out = np.concatenate(done_seg), np.concatenate(done_symbols)
    return out[np.argsort(segs, kind="stable")], np.bincount(segs, minlength=len(lengths))


def merge_long(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """One long sequence by a heap of its adjacent pairs, best rank first, then leftmost."""
    symbols = symbols.astype(np.int64)
    n = len(symbols)
    entry, rank = _pairs(table, symbols, np.zeros(n, np.int64))
    value, before, after = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    stamp, entries = [0] * n, entry.tolist()
    agenda = [(r, i, 0) for i, r in enumerate(rank.tolist()) if r < NONE]
    heapq.heapify(agenda)
    memo: dict[tuple[int, int], int] = {}

    def offer(i: int) -> None:
        stamp[i] += 1
        entries[i] = -1
        if i >= 0 and after[i] < n:
            pair = value[i], value[after[i]]
            if pair not in memo:
                memo[pair] = int(table.find(np.array(pair[:1]), np.array(pair[1:]))[0])
            entries[i] = memo[pair]
            if entries[i] >= 0:
                heapq.heappush(agenda, (int(table.rank[entries[i]]), i, stamp[i]))

    while agenda:
        _, i, mark = heapq.heappop(agenda)
        if mark != stamp[i]:
            continue
        gone = after[i]
        value[i] = int(table.merged[entries[i]])
        after[i] = after[gone]
        stamp[gone] += 1
        entries[gone] = -1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(value[i])
        i = after[i]
    return np.array(out, np.int64)
