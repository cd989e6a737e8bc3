"""Exact join of shingle sets, with SimHash fingerprints as its first search.

Fingerprints within a few bits, found by the trie join, link most copies. What they leave open is
decided by the sets themselves: two sets of a wanted share have a shingle in common among the
first ones of each in one order of all shingles. A linked pair is always checked by its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import chunks, give_back, large_text
from contrail.llm.bitmap import bitmap, maybe_in, unpacked
from contrail.llm.components import components
from contrail.llm.simhash import majority, shingle_array
from contrail.llm.trie_join import hamming_links
from contrail.sources.scratch import materialize

LEAST_PARITIES = 256  # bits
AT_ONCE = 1 << 20  # words compared at once
SMALL = 32  # a shingle of at most so many sets gives its pairs before their parities are looked at
BLOCK = 256  # sets of one shingle in one part; parts meet pairwise


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls into each of some cells, two or more for each element.

    The number of cells is a power of two; both halves together, added bit by bit, are the parities
    of half as many cells. Two sets differ in as many elements at least as these differ in bits.
    """
    cells = max(LEAST_PARITIES, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Parities:
    """Parities of many sets, compared by their positions."""

    def __init__(self, *columns: pa.Array):
        values = [v for c in columns for v in c.to_pylist()]
        self.words = np.frombuffer(b"".join(values), np.uint64)
        self.sizes = np.array([len(v) // 8 for v in values], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _rows(self, at: np.ndarray, size: int, wanted: int) -> np.ndarray:
        rows = self.words[self.starts[at][:, None] + np.arange(size)]
        while rows.shape[1] > wanted:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of each pair, at the smaller of its two numbers of cells."""
        out = np.zeros(len(i), np.int64)
        if not len(i):
            return out
        pair = self.sizes[i] << 32 | self.sizes[j]
        for kind in np.unique(pair).tolist():
            a, b = kind >> 32, kind & 0xFFFFFFFF
            of_kind = np.flatnonzero(pair == kind)
            step = max(1, AT_ONCE // max(a, b))
            for low in range(0, len(of_kind), step):
                at = of_kind[low : low + step]
                differ = self._rows(i[at], a, min(a, b)) ^ self._rows(j[at], b, min(a, b))
                out[at] = np.bitwise_count(differ).sum(1, dtype=np.int64)
        return out


def _prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """First shingles in the order of all sets, ``common`` ones last: sets of the wanted share have one of these in common."""
    n = len(hashes)
    k = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
    if not len(common):
        return hashes[:k]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    place = np.where(common[at] == hashes, rank[at] + 1, 0)
    return hashes[np.lexsort((hashes, place))[:k]]


def _limits(n: np.ndarray, m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes n and m allow the share, and the most elements that two such sets may differ in."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6, (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _meets(n, m, i, j, similarity: float):
    """Whether sets of n and m elements can have the share if i and j elements come before their first common one.

    Works on columns and on arrays: comparisons and sums only.
    """
    wanted = (n + m) * (similarity / (1 + similarity)) - 1e-6
    return (n >= similarity * m - 1e-6) & (m >= similarity * n - 1e-6) & (n - i >= wanted) & (m - j >= wanted)


def _common_shingles(rows: DataFrame, width: int, most: int = 10_000, kept: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts (from 16 on), by a sample, and their ranks. They only order shingles: a missing one costs time, not results."""
    n = rows.count()
    share = min(1.0, max(1 / 16, most / max(1, n)))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = [shingle_array(t, width).view(np.int64) for t in large_text(part.column("text")).to_pylist()]
            names = [xxhash.xxh64_intdigest(x) for x in found]
            columns = [pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingles"])

    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1024)) < math.ceil(1024 * share)).select("text")
    sets = sample.mapInArrow(shingled, "id long, shingles array<long>").dropDuplicates(["id"])
    often = sets.select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    found = often.filter(F.col("c") >= max(4, 16 * share)).orderBy(F.desc("c"), "t").limit(kept).toPandas()
    common, c = found["t"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(common)
    rank = np.empty(len(c), np.int64)
    rank[np.lexsort((common, c))] = np.arange(len(c))
    return common[order], rank[order]


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that can be similar by size and parities, with far, the parities that differ."""
    bits = sets.select("id", "bits", "n")
    both = pairs.join(bits.toDF("a", "bits", "n"), "a").join(bits.toDF("b", "other", "m"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            fits, most = _limits(n, m, similarity)
            at = np.flatnonzero(fits)
            far = Parities(batch.column("bits"), batch.column("other")).far(at, at + len(n))
            at, far = at[far <= most[at]], far[far <= most[at]]
            columns = [pa.array(batch.column(c).to_numpy()[at]) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(far)], ["a", "b", "far"])
        give_back()

    return both.mapInArrow(run, "a long, b long, far long")


def _nearest(links: DataFrame) -> DataFrame:
    """Of the possible links (a, b, far) the nearest one of each set."""
    one = F.min(F.struct("far", "b")).alias("x")
    both = links.select("a", "b", "far").union(links.select("b", "a", "far"))
    found = both.groupBy("a").agg(one).select("a", F.col("x.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Possible links (a, b, far): sets with one set of each of their shingles."""
    centers = open_.groupBy("t").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n", "root", "pos")).alias("c"))
    own = {"id": "b", "n": "m", "root": "other", "pos": "q"}
    centers = materialize(centers.select("t", *[F.col(f"c.{c}").alias(name) for c, name in own.items()]), "centers")
    near = _meets(*map(F.col, ("n", "m", "pos", "q")), similarity)
    pairs = open_.join(centers, "t").filter((F.col("root") != F.col("other")) & near)
    return _likely(pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), sets, similarity)


def _pairs_of_small(groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots within ``rows``, short lists of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            rows, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            name, n, root, pos = (rows.field(c).to_numpy() for c in ("id", "n", "root", "pos"))
            for step in range(1, SMALL):
                i = np.flatnonzero(of[step:] == of[:-step])
                if not len(i):
                    break
                j = i + step
                keep = (root[i] != root[j]) & _meets(n[i], n[j], pos[i], pos[j], similarity)
                a, b = name[i[keep]], name[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        give_back()

    return groups.mapInArrow(run, "a long, b long").distinct()


def _pairs_of_large(blocks: DataFrame, similarity: float) -> DataFrame:
    """Possible links (a, b, far) within ``rows``, two parts x and y of the sets of a shingle; x = y: within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("x")[row].as_py() == batch.column("y")[row].as_py()
                rows = batch.column("rows")[row].values
                order = np.argsort(rows.field("n").to_numpy(), kind="stable")
                name, n, root, part, pos = (rows.field(c).to_numpy()[order] for c in ("id", "n", "root", "i", "pos"))
                bits = Parities(rows.field("bits").take(pa.array(order)))
                ends = np.searchsorted(n, n / similarity + 1e-6, side="right")  # sets that are not too large
                more = ends - np.arange(len(n)) - 1
                i = np.repeat(np.arange(len(n)), more)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
                open_ = (root[i] != root[j]) & (own | (part[i] != part[j])) & _meets(n[i], n[j], pos[i], pos[j], similarity)
                i, j = i[open_], j[open_]
                far = bits.far(i, j)
                near = far <= _limits(n[i], n[j], similarity)[1]
                both = np.stack([name[i[near]], name[j[near]]])
                yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0)), pa.array(far[near])], ["a", "b", "far"])
        give_back()

    return blocks.mapInArrow(run, "a long, b long, far long").distinct()


def _all_pairs(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All possible links (a, b, far) of sets with a shingle in common and different roots."""
    counts = materialize(open_.groupBy("t").agg(F.count("*").alias("c")), "counts")
    few = open_.join(counts.filter(F.col("c") <= SMALL), "t").groupBy("t")
    few = _pairs_of_small(few.agg(F.collect_list(F.struct("id", "n", "root", "pos")).alias("rows")).select("rows"), similarity)
    parts = counts.filter(F.col("c") > SMALL).select("t", F.ceil(F.col("c") / BLOCK).alias("parts"))
    i, j = F.pmod(F.xxhash64("id"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = open_.join(parts, "t").join(sets.select("id", "bits"), "id").withColumn("i", i).withColumn("j", j)
    one = F.struct("id", "n", "root", "pos", "i", "bits")
    blocks = rows.groupBy("t", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y")).agg(F.collect_list(one).alias("rows"))
    return _likely(few, sets, similarity).union(_pairs_of_large(blocks, similarity)).distinct()


def _fingerprint_links(kinds: DataFrame, budget: int, leaf: int) -> DataFrame:
    """Possible links (a, b): sets of one fingerprint, and a forest over fingerprints within ``budget`` bits."""
    first = materialize(kinds.groupBy("fp").agg(F.min("id").alias("id")), "different_fingerprints")
    same = kinds.select("fp", F.col("id").alias("a")).join(first.withColumnRenamed("id", "b"), "fp").filter("a <> b")
    return same.select("a", "b").union(hamming_links(first, budget, leaf)).distinct()


def similar_documents(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", budget: int = 4, leaf: int = 16_384
) -> DataFrame:
    """Rows that share at least ``similarity`` of their different shingles of ``width`` words, chained: key, component_id.

    One row per row of ``docs`` with a key; component_id is the smallest key reachable. Exact:
    fingerprints of the sets within ``budget`` bits give the first links. Then each set that has a
    shingle in common with others, among the first ones of each (1 - similarity of a set, and
    one) in one order of all shingles, meets one set of each such shingle; then all pairs within
    such a shingle are taken that are not linked yet. Bounds by size, by the shingle's place in both
    sets and by parities drop pairs that cannot be similar, the others are checked by their shares. Common shingles come last in the
    order; they are told by a sample. Equal sets are one. Rows without words are copies of each
    other. Null keys are left out; repeated rows stay; other columns aren't read; an empty table
    gives an empty result.

    Broadcast are bitmaps of fixed size, which keep shingles that no other set has and texts that
    no link needs out of the shuffles; a bit set by chance costs time, not results.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter("key is not null")
    kind, context = rows.schema["key"].dataType, rows.sparkSession.sparkContext
    shared = context.broadcast(_common_shingles(rows, width))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = [shingle_array(t, width) for t in large_text(part.column("text")).to_pylist()]
            columns = [
                part.column("key"),
                pa.array(np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64)),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array(np.array([majority(x) for x in found], np.uint64).view(np.int64)),
                pa.array([parities(x) for x in found], pa.binary()),
                pa.array([_prefix(x, similarity, *shared.value).view(np.int64) for x in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "fp", "bits", "prefix"])

    schema = T.StructType().add("key", kind).add("id", "long").add("n", "long").add("fp", "long").add("bits", "binary").add("prefix", T.ArrayType(T.LongType()))
    known = materialize(rows.mapInArrow(described, schema), "sets")
    own = [F.first(c).alias(c) for c in ("n", "fp", "bits")]  # a set decides them
    kinds = materialize(known.groupBy("id").agg(F.min("key").alias("first"), *own), "different_sets")
    each = known.select(F.explode("prefix").alias("t"), "id").groupBy("t").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    several = materialize(each.filter("low < high").select("t"), "shingles_of_several")
    open_shingles = context.broadcast(bitmap(several))

    def of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(open_shingles.value)
        for b in batches:
            lists = b.column("prefix")
            t, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(starts))
            keep = maybe_in(bits, t.to_numpy())
            at, pos = pa.array(row[keep]), (np.arange(len(t)) - starts[row])[keep]
            columns = [t.filter(pa.array(keep)), b.column("id").take(at), b.column("n").take(at), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(columns, ["t", "id", "n", "pos"])
        give_back()

    tokens = known.select("id", "n", "prefix").mapInArrow(of_several, "t long, id long, n long, pos long")
    tokens = materialize(tokens.join(several, "t").dropDuplicates(["t", "id"]), "shared_shingles")
    common = F.size(F.array_intersect("x", "y"))
    share = common / (F.size("x") + F.size("y") - common)

    def similar(links: DataFrame) -> DataFrame:
        """The links whose sets have the share; only texts that may be wanted leave their task."""
        links = materialize(links, "links_to_check")
        wanted = materialize(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "wanted")
        some = context.broadcast(bitmap(kinds.join(wanted, "id").select(F.xxhash64("first"))))

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = unpacked(some.value)
            for part in chunks(batches):
                part = part.filter(pa.array(maybe_in(bits, part.column("h").to_numpy())))
                found = [shingle_array(t, width) for t in large_text(part.column("text")).to_pylist()]
                names = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([names, pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["id", "shingles"])

        sets = rows.select(F.xxhash64("key").alias("h"), "text").mapInArrow(shingled, "id long, shingles array<long>")
        sets = materialize(sets.join(wanted, "id").dropDuplicates(["id"]), "shingles")
        a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(x)) for c, x in (("a", "x"), ("b", "y")))
        return materialize(links.join(a, "a").join(b, "b").filter(share >= similarity).select("a", "b"), "links")

    def rooted(roots: DataFrame) -> DataFrame:
        """Rows of the shingles whose sets are not all linked yet."""
        now = tokens.join(roots.withColumnRenamed("a", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        apart = now.groupBy("t").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("t")
        return materialize(now.join(materialize(apart, "open"), "t"), "open_shingles")

    links = similar(_likely(_fingerprint_links(kinds, budget, leaf), kinds, similarity).select("a", "b"))
    roots = components(links)
    for search in (_stars, _all_pairs):
        possible = materialize(search(rooted(roots), kinds, similarity), "possible")
        # Each set is checked with its nearest one; then what is still between two components goes on.
        while possible.take(1):
            found = materialize(_nearest(possible), "nearest")
            links = links.union(similar(found))
            roots = components(links)
            if search is _stars:
                break  # the rest is found again among all pairs
            own = roots.select(F.col("a").alias("id"), "root")
            left = possible.join(found, ["a", "b"], "left_anti")
            for c in ("a", "b"):
                left = left.join(own.toDF(c, f"root_{c}"), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
            possible = materialize(left.filter("root_a <> root_b").select("a", "b", "far"), "possible")
    owned = kinds.select("id", "first").join(roots.withColumnRenamed("a", "id"), "id", "left")
    owned = materialize(owned.withColumn("root", F.coalesce("root", "id")), "set_roots")
    least = materialize(owned.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    classes = materialize(owned.join(least, "root").select("id", "component_id"), "set_classes")
    return known.select("key", "id").join(classes, "id").select(F.col("key").alias(key), "component_id")
