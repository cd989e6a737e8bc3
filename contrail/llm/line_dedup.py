"""Line dedup: suffix order over line numbers by distributed prefix doubling, later copies of repeated runs deleted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import carried, chunks, large_text
from contrail.sources.scratch import materialize


def _filled(lines: list[str]) -> list[int]:
    """Numbers of the lines that hold a word; blank ones are no part of a run."""
    return [i for i, line in enumerate(lines) if line and not line.isspace()]


def windows(counts: np.ndarray, least: int) -> list[list[int]]:
    """For each line the lengths of the shortest runs of ``least`` words that start there.

    Shortest either read forwards from their first line or backwards from their last. Every run
    of ``least`` words or more is covered by such runs inside it.
    """
    total = np.r_[0, np.cumsum(counts)]
    n = len(counts)
    ahead = np.searchsorted(total, total[:-1] + least)  # first end by which the words are reached
    behind = np.searchsorted(total, total[1:] - least, side="right") - 1  # last start from which they are
    found: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        if ahead[i] <= n:
            found[i].add(int(ahead[i]) - i)
        if behind[i] >= 0:
            found[int(behind[i])].add(i + 1 - int(behind[i]))
    return [sorted(x) for x in found]


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """key, digest, n (number among the filled lines), line (its digest), lens (of the runs that start there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            row, n, line, lens, digests = [], [], [], [], []
            for i, text in enumerate(large_text(part.column("text")).to_pylist()):
                lines = text.split("\n")
                kept = [lines[k] for k in _filled(lines)]
                digests.append(hashlib.md5(text.encode()).digest())
                row += [i] * len(kept)
                n += range(len(kept))
                line += [hashlib.md5(x.encode()).digest() for x in kept]
                lens += windows(np.array([len(x.split()) for x in kept], np.int64), least)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key").take(row), pa.array(digests, pa.binary()).take(row), pa.array(n, pa.int32()),
                    pa.array(line, pa.binary()), pa.array(lens, pa.list_(pa.int32())),
                ],
                ["key", "digest", "n", "line", "lens"],
            )

    schema = T.StructType().add("key", rows.schema["key"].dataType).add("digest", "binary").add("n", "integer")
    return rows.mapInArrow(run, schema.add("line", "binary").add("lens", T.ArrayType(T.IntegerType())))


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Number the classes (``by``, m members) in their order: rank is the number of suffixes before the class.

    A range shuffle by sampled splitters, then sums inside partitions; only their totals meet on
    the driver.
    """
    spark = classes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for b in batches:
            m = b.column("m").to_numpy()
            ends = before + np.cumsum(m)
            columns = [b.column(c) for c in by] + [pa.array(ends - m), pa.array(np.full(len(m), part))]
            before = int(ends[-1]) if len(m) else before
            yield pa.RecordBatch.from_arrays(columns + [b.column("m")], [*by, "place", "part", "m"])

    schema = T.StructType([classes.schema[c] for c in by]).add("place", "long").add("part", "long").add("m", "long")
    dealt = classes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    found = materialize(dealt.sortWithinPartitions(*by).mapInArrow(run, schema), "ranks")
    totals, start, before = found.groupBy("part").agg(F.sum("m").alias("m")).collect(), [], 0
    for r in sorted(totals, key=lambda r: r.part):
        start.append((r.part, before))
        before += r.m
    starts = spark.createDataFrame(start, "part long, start long")
    return found.join(F.broadcast(starts), "part").select(*by, (F.col("place") + F.col("start")).alias("rank"))


def repeated_runs(rows: DataFrame, least: int) -> DataFrame:
    """Runs that are later copies: key, digest, n, length. ``rows`` has key and text.

    Level k ranks windows of 2^k lines among all that occur more than once: the ranks are the
    bounds of the longest-common-prefix intervals of that depth in the suffix order. A window of
    any length between two levels is named by the ranks of the two level windows that cover it.
    """
    level = materialize(_lines(rows, least), "lines")
    heads = level.filter("n = 0").select("key", "digest")
    if heads.count() > heads.distinct().count():
        level = materialize(level.dropDuplicates(["key", "digest", "n"]), "lines")
    most = level.agg(F.max(F.array_max("lens"))).first()[0] or 0
    classes = level.groupBy("line").agg(F.count("*").alias("m")).filter("m > 1")
    ranks = _ranked(classes, ["line"])
    level = materialize(level.join(ranks, "line").select("key", "digest", "n", "lens", "rank"), "level")
    found, width = None, 1
    while width <= most:
        mine = F.filter("lens", lambda x: (x >= width) & (x < 2 * width))
        runs = level.select("key", "digest", "n", F.col("rank").alias("r"), F.explode(mine).alias("length"))
        even = runs.filter(F.col("length") == width).withColumn("r2", F.col("r"))
        last = level.select(F.struct("key", "digest").alias("d"), F.col("n").alias("n2"), F.col("rank").alias("r2"))
        odd = runs.filter(F.col("length") > width).withColumn("n2", F.col("n") + F.col("length") - width)
        odd = odd.withColumn("d", F.struct("key", "digest")).join(last, ["d", "n2"]).select(even.columns)
        both = materialize(even.unionByName(odd) if width > 1 else even, "runs")
        found = both if found is None else found.unionByName(both)
        if 2 * width <= most:
            ahead = level.select(F.struct("key", "digest").alias("d"), (F.col("n") - width).alias("n"), F.col("rank").alias("ahead"))
            pairs = level.withColumn("d", F.struct("key", "digest")).join(ahead, ["d", "n"]).drop("d")
            pairs = materialize(pairs, "pairs")
            ranks = _ranked(pairs.groupBy("rank", "ahead").agg(F.count("*").alias("m")).filter("m > 1"), ["rank", "ahead"])
            level = pairs.join(ranks.toDF("rank", "ahead", "next"), ["rank", "ahead"])
            level = materialize(level.select("key", "digest", "n", "lens", F.col("next").alias("rank")), "level")
        width *= 2
    if found is None:
        return level.select("key", "digest", "n", F.lit(0).alias("length"))
    at = F.struct("key", "digest", "n")
    name = ["length", "r", "r2"]
    first = found.groupBy(*name).agg(F.min(at).alias("first"), F.count("*").alias("m")).filter("m > 1")
    first = materialize(first, "first_runs")  # written, so that a hot run can be split
    return found.join(first, name).filter(at != F.col("first")).select("key", "digest", "n", "length")


def dedup_lines(
    docs: DataFrame, least: int = 50, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Delete runs of lines of ``least`` words or more that occur before, in this text or another.

    A run is a stretch of consecutive lines, blank ones (no word) left out; it counts as repeated
    if the same lines stand in the same order earlier, by key, then by place in the text. Every
    line of a later copy goes, the first copy stays. Result: ``key``, text (the lines left), n_lines
    and n_removed (lines with a word). Blank lines stay, but a text that loses every line becomes
    empty. A null text is given back as null with no lines. Rows that agree in key and text count as one and get the same
    result; a null key is before all others; other columns aren't read, but those of ``carry`` (not
    the text) come along as the struct carried; an empty table gives an empty result.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    along = carried(docs, carry, text)
    gone = repeated_runs(rows, least).groupBy(F.struct("key", "digest").alias("d"))
    gone = gone.agg(F.sort_array(F.collect_set(F.struct("n", "length"))).alias("runs"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *along)
    along = rows.columns[2:]
    whole = rows.withColumn("d", F.struct("key", digest.alias("digest"))).join(gone, "d", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts, n, removed = [], [], []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                lines = (text or "").split("\n")
                filled = _filled(lines)
                drop = {filled[i] for run in runs or () for i in range(run["n"], run["n"] + run["length"])}
                n.append(len(filled))
                removed.append(len(drop))
                if drop:
                    text = "" if len(drop) == len(filled) else "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
                + [part.column(c) for c in along],
                ["key", "text", "n_lines", "n_removed", *along],
            )

    schema = T.StructType().add("key", rows.schema["key"].dataType).add("text", "string")
    schema = schema.add("n_lines", "long").add("n_removed", "long")
    for c in along:
        schema = schema.add(c, rows.schema[c].dataType)
    out = whole.select("key", "text", "runs", *along).mapInArrow(cut, schema)
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "n_lines", "n_removed", *along)
