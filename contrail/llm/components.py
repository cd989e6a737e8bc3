"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.sources.scratch import materialize

PART = 1 << 20  # links in one task


def _stars(links: DataFrame, parts: int) -> DataFrame:
    """Links (a, b; b the smallest of what is linked) that join what ``links`` joins, each part by itself: one row per value at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
        if not found:
            return
        values, at = np.unique(np.concatenate(found, 1), return_inverse=True)
        (a, b), labels = at.reshape(2, -1), np.arange(len(values))
        while len(a):
            x, y = labels[a], labels[b]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := labels[labels], labels):
                labels = up
            open_ = labels[a] != labels[b]
            a, b = a[open_], b[open_]
        linked = np.flatnonzero(labels != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[labels[linked]])], ["a", "b"])

    return links.select(*[F.col(c).cast("long") for c in ("a", "b")]).repartition(parts).mapInArrow(run, "a long, b long")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(materialize(least, "least"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    others = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Root of every value of ``links`` (a, b; numbers) that is not its component's smallest: (a, root).

    A link of a value with itself has no effect. Tasks of up to ``PART`` links reduce their part to
    stars first; one such part is the result, several go through rounds. Each round is a written table, so lineage stays
    short. So is the least neighbour of each value: both sides of a join are then shuffled, which
    lets adaptive execution split a hot value.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = materialize(links, "links"), None
    parts = max(1, math.ceil(links.count() / PART))
    links = materialize(_stars(links, parts), "links")
    if parts == 1:
        return links.select("a", F.col("b").alias("root"))
    for _ in range(most_rounds):
        links = materialize(_large_star(links).distinct(), "links")
        links = materialize(_small_star(links).filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before or not now[0]:
            return links.select("a", F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
