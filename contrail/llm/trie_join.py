"""Self-join of 64-bit fingerprints within a Hamming budget by joint traversal of a binary trie.

Node pairs of the upper levels are joined level by level as tables; below them each pair of
subtries of bounded size is traversed in one task. Both add up differing bits on the way down and
drop a pair of nodes whose bits exceed the budget.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.batches import give_back
from contrail.sources.scratch import materialize

BITS = 64
DIRECT = 48  # node pairs with at most so many value pairs are compared value by value
FRONT = 1 << 16  # node pairs handled at once
DIRECT_ROWS = 1 << 19  # value pairs compared at once


class _Trie:
    """Nodes of each depth over sorted values, built when first asked for."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, {}

    def starts(self, depth: int) -> np.ndarray:
        if depth not in self.levels:
            top = self.values >> np.uint64(BITS - depth) if depth else np.zeros(len(self.values), np.uint64)
            self.levels[depth] = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        return self.levels[depth]

    def sizes(self, depth: int) -> np.ndarray:
        return np.diff(np.r_[self.starts(depth), len(self.values)])

    def child(self, depth: int, node: np.ndarray, bit: int) -> np.ndarray:
        """Child of each node on one side, -1 if there is none."""
        below, first = self.starts(depth + 1), np.searchsorted(self.starts(depth + 1), self.starts(depth))
        own = (self.values[below] >> np.uint64(BITS - 1 - depth) & np.uint64(1)).astype(np.int8)
        one = np.r_[first[1:], len(below)] - 1  # last child
        at = one if bit else first
        return np.where(own[at] == bit, at, -1)[node]


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of linked positions; each label is the least position of its component."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def _products(first: np.ndarray, second: np.ndarray, wide: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all value pairs of node pairs, a bounded number at once: n pairs, ``wide`` of them to a row."""
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]) if len(n) else 0, DIRECT_ROWS):
        at = np.arange(low, min(low + DIRECT_ROWS, int(ends[-1])))
        which = np.searchsorted(ends, at, side="right")
        k = at - (ends - n)[which]
        yield first[which] + k // wide[which], second[which] + k % wide[which]


def traverse(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0, differing: int = 0) -> np.ndarray:
    """Links (k x 2 positions; right ones behind the left) that join all values within ``budget`` bits into their components.

    ``left`` and ``right`` are sorted different values below one node each, at ``depth``, whose
    prefixes differ in ``differing`` bits; ``right`` is None for the pairs inside ``left``. Node
    pairs that are already one component are skipped: their links would add nothing.
    """
    self_join = right is None
    a, b = _Trie(left), _Trie(left if self_join else right)
    if self_join:
        b = a
    shift = 0 if self_join else len(left)
    size = len(left) + (0 if self_join else len(right))
    labels, linked = np.arange(size), False
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero, np.full(1, differing, np.int64))]
    while stack:
        t, ia, ib, d = stack.pop()
        if len(ia) > FRONT:
            half = len(ia) // 2
            stack += [(t, ia[:half], ib[:half], d[:half]), (t, ia[half:], ib[half:], d[half:])]
            continue
        if linked:
            same = []
            for trie, offset in ((a, 0), (b, shift)):
                own, starts = labels[offset : offset + len(trie.values)], trie.starts(t)
                least, most = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
                same.append(np.where(least == most, least, -1 - offset))
            open_ = (same[0][ia] != same[1][ib]) | (same[0][ia] < 0)
            ia, ib, d = ia[open_], ib[open_], d[open_]
        na, nb = a.sizes(t)[ia], b.sizes(t)[ib]
        direct = (na * nb <= DIRECT) | (t == BITS)
        first, second, n = a.starts(t)[ia[direct]], b.starts(t)[ib[direct]], (na * nb)[direct]
        wide = nb[direct]
        for x, y in _products(first, second, wide, n):
            near = np.bitwise_count(a.values[x] ^ b.values[y]) <= budget
            if self_join:
                near &= x < y
            if near.any():
                labels, linked = _settle(labels, x[near], y[near] + shift), True
        ia, ib, d = ia[~direct], ib[~direct], d[~direct]
        if not len(ia):
            continue
        below = []
        sides = [[trie.child(t, at, bit) for bit in (0, 1)] for trie, at in ((a, ia), (b, ib))]
        for bit_a in (0, 1):
            for bit_b in (0, 1):
                ca, cb, now = sides[0][bit_a], sides[1][bit_b], d + (bit_a != bit_b)
                keep = (ca >= 0) & (cb >= 0) & (now <= budget)
                if self_join:
                    keep &= ca <= cb
                below.append((ca[keep], cb[keep], now[keep]))
        stack.append((t + 1, *map(np.concatenate, zip(*below))))
    joined = np.flatnonzero(labels != np.arange(size))
    return np.stack([joined, labels[joined]], 1)


def _node_pairs(nodes: DataFrame, depth: int, budget: int, step: int = 4) -> DataFrame:
    """Pairs (a <= b) of nodes of ``depth`` whose prefixes differ in at most ``budget`` bits: a, b, d."""
    root = F.shiftright("node", depth) if depth else F.col("node")
    pairs = nodes.select(root.alias("a"), root.alias("b")).distinct().withColumn("d", F.lit(0).cast("long"))
    for at in range(0, depth, step):
        bits = min(step, depth - at)
        node = F.shiftright("node", depth - at - bits)
        level = nodes.select(node.alias("child"), F.shiftright(node, bits).alias("parent")).distinct()
        left = level.select(F.col("parent").alias("a"), F.col("child").alias("x"))
        right = level.select(F.col("parent").alias("b"), F.col("child").alias("y"))
        more = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
        pairs = pairs.join(left, "a").join(right, "b").filter("x <= y").withColumn("d", F.col("d") + more)
        pairs = pairs.filter(F.col("d") <= budget).select(F.col("x").alias("a"), F.col("y").alias("b"), "d")
    return pairs


def hamming_links(values: DataFrame, budget: int, leaf: int = 16_384) -> DataFrame:
    """Links (a, b) that join every two of ``values`` (id, fp; the fps are different) within ``budget`` bits of fp, by their ids.

    Not every pair is listed: each task gives a spanning forest of what it found. Subtries hold
    about ``leaf`` values; one with more is dealt into parts by hash, and parts meet pairwise.
    Pairs of parts are numbered, so that each task gets about the same number of them.
    """
    n = values.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf))) if n else 0
    node = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    placed = values.select("fp", "id", node.alias("node"))
    nodes = placed.groupBy("node").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    nodes = materialize(nodes, "trie_nodes")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = F.sort_array(F.collect_list(F.struct("fp", "id")))
    blocks = placed.join(nodes, "node").groupBy("node", part.alias("part")).agg(rows.alias("rows"))
    blocks = materialize(blocks, "trie_blocks")
    pairs = _node_pairs(nodes, depth, budget)
    ids = blocks.select("node", "part")
    left = ids.select(F.col("node").alias("a"), F.col("part").alias("i"))
    right = ids.select(F.col("node").alias("b"), F.col("part").alias("j"))
    pairs = materialize(pairs.join(left, "a").join(right, "b").filter("a < b or i <= j"), "block_pairs")
    left = blocks.select(F.col("node").alias("a"), F.col("part").alias("i"), F.col("rows").alias("left"))
    right = blocks.select(F.col("node").alias("b"), F.col("part").alias("j"), F.col("rows").alias("right"))
    tasks = max(1, min(2000, pairs.count()))
    dealt = pairs.join(left, ["a", "i"]).join(right, ["b", "j"]).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                own = one["a"].as_py() == one["b"].as_py() and one["i"].as_py() == one["j"].as_py()
                fps, names = [], []
                for side in ("left", "right"):
                    rows = one[side].values
                    fp = rows.field("fp").to_numpy().view(np.uint64)
                    order = np.argsort(fp)
                    fps.append(fp[order])
                    names.append(rows.field("id").to_numpy()[order])
                found = traverse(fps[0], None if own else fps[1], budget, depth, one["d"].as_py())
                name = names[0] if own else np.concatenate(names)
                yield pa.RecordBatch.from_arrays([pa.array(name[found[:, 0]]), pa.array(name[found[:, 1]])], ["a", "b"])
        give_back()

    return dealt.mapInArrow(run, "a long, b long")
