"""Audit of how filters interact: what each order of them removes, and what that costs in labels.

Each filter has one table of the ids that fail it. Starting from these relations, left-anti joins
with the tables of further filters give what a filter still removes behind any set of others, and
left-semi joins what it would have removed but finds gone. Orders with the same filters in front
share one relation, and rows that fail nothing are only counted.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.sources.scratch import materialize, new_path

_SPACES = r"[\x20\x09-\x0D]+"
#: Failure conditions of the filters A to D on a text without nulls. Fixed values.
TEXT_FILTERS = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"  # the filter on texts that a smaller key has as well


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def _failures(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """One row for each row of ``docs``: row (a number of its own), part, fails (filters), good, toxic."""
    content = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("content"), _words(content).alias("words"),
    )
    failed = [F.when(f(F.col("content"), F.col("words")), F.lit(name)) for name, f in TEXT_FILTERS.items()]
    rows = rows.select("row", "key", "part", "digest", F.array_compact(F.array(*failed)).alias("fails"))
    rows = materialize(rows, "judged")  # from here on a row keeps its number
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(materialize(first, "first_copies"), "digest", "left")
    named = labels.select(labels[key].alias("key"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    named = named.groupBy("key").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    named = materialize(named.filter("key is not null and (good or toxic)"), "label_rows")
    all_ = F.when(F.col("key") > F.col("first"), F.array_append("fails", F.lit(COPIES))).otherwise(F.col("fails"))
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return materialize(rows.join(named, "key", "left").select("row", "part", all_.alias("fails"), *known), "failures")


def _id_tables(failures: DataFrame) -> DataFrame:
    """The failing ids as one stored table for each filter, seen as one relation: filter, row, part, good, toxic."""
    spark = failures.sparkSession
    path = new_path(spark, "failing_ids")
    rows = failures.select(F.explode("fails").alias("filter"), "row", "part", "good", "toxic")
    rows.write.partitionBy("filter").parquet(path)
    return spark.read.schema("row long, part string, good boolean, toxic boolean, filter string").parquet(path)


def _sums(rows: DataFrame, kind: str) -> DataFrame:
    counted = rows.groupBy("part", "before", "filter").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    return counted.withColumn("kind", F.lit(kind))


def _removals(ids: DataFrame, filters: Sequence[str]) -> DataFrame:
    """For each part, set of filters in front (letters in order) and filter: rows removed, and rows found gone.

    A set grows by its filters in order, so each one is reached once: from n failing ids come at
    most 2^(filters - 1) rows in all. ``gone`` counts what the last filter of the set took.
    """
    now = ids.withColumn("before", F.lit(""))
    sums = [_sums(now, "removed")]
    failing = ids.select(F.col("filter").alias("next"), "row")
    for _ in range(len(filters) - 1):
        further = F.filter(F.array(*map(F.lit, filters)), lambda f: (f > F.substring("before", -1, 1)) & (f != F.col("filter")))
        tried = now.withColumn("next", F.explode(further))
        found, left = (tried.join(failing, ["next", "row"], how) for how in ("left_semi", "left_anti"))
        named = lambda rows: rows.withColumn("before", F.concat("before", "next")).drop("next")
        now = materialize(named(left), "still_removed")
        sums += [_sums(now, "removed"), _sums(named(found), "gone")]
    return materialize(functools.reduce(DataFrame.unionByName, sums), "removals")


def _constant(rows: list[dict], kind: str) -> Column:
    """A fixed table as rows of its own behind every row."""
    return F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>"))


def _orders(filters: Sequence[str]) -> Column:
    """Every step of every order: filter_order, step, filter, before (filters in front, letters in order)."""
    rows = [
        {"filter_order": "".join(order), "step": i + 1, "filter": order[i], "before": "".join(sorted(order[:i]))}
        for order in itertools.permutations(filters)
        for i in range(len(order))
    ]
    return _constant(rows, "filter_order: string, step: int, filter: string, before: string")


def _prefixes(filters: Sequence[str]) -> Column:
    """filter, before and each of its prefixes that is not empty."""
    rows = []
    for f in filters:
        others = [x for x in filters if x != f]
        for n in range(1, len(filters)):
            for before in map("".join, itertools.combinations(others, n)):
                rows += [{"filter": f, "before": before, "prefix": before[: i + 1]} for i in range(n)]
    return _constant(rows, "filter: string, before: string, prefix: string")


def audit_filters(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Every part, every order of the five filters and every step of it.

    Columns: part, filter_order, step, kept, removed, redundant (failing its filter, removed
    earlier), unique_fails (failing its filter only), good_lost, toxic_lost, shapley (the
    filter's removed summed over all orders). Filters: ``TEXT_FILTERS`` and ``COPIES``, texts that
    a row of smaller key anywhere in the table has as well, removed or not.

    A null text is empty (and empty texts are copies of each other), a null part is the empty
    string. A row with a null key is no copy and makes none, and has no label. Repeated rows count
    again; rows of one key and text are no copies of each other. Labels of one key add up; labels
    without a row have no effect; other columns aren't read; an empty table gives an empty result.
    Rows that fail something pass through ``2^4`` relations of a few short columns each; words are
    an array inside one row, so memory follows the longest text.
    """
    filters = [*TEXT_FILTERS, COPIES]
    failures = _failures(docs, labels, key, text, part)
    parts = materialize(failures.groupBy("part").agg(F.count("*").alias("rows")), "parts")
    removals = _removals(_id_tables(failures), filters)
    removed = removals.filter("kind = 'removed'").drop("kind").withColumnsRenamed({"n": "removed", "good": "good_lost", "toxic": "toxic_lost"})
    gone = removals.filter("kind = 'gone'").select("part", "filter", F.col("before").alias("prefix"), F.col("n").alias("gone"))
    at = ["part", "filter", "before"]
    redundant = parts.select("part", _prefixes(filters)).join(gone, ["part", "filter", "prefix"])
    redundant = redundant.groupBy(at).agg(F.sum("gone").alias("redundant"))
    alone = removed.filter(F.length("before") == len(filters) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    # Orders that have a set of k filters in front of a filter: k! ways before it, the rest behind it.
    ways = [math.factorial(k) * math.factorial(len(filters) - 1 - k) for k in range(len(filters))]
    weight = F.element_at(F.array(*map(F.lit, ways)), F.length("before") + 1)
    shares = removed.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    found = parts.select("part", "rows", _orders(filters)).join(removed, at, "left").join(redundant, at, "left")
    found = found.join(alone, ["part", "filter"], "left").join(shares, ["part", "filter"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    found = found.select("part", "filter_order", "step", "rows", *counts)
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    kept = (F.col("rows") - F.sum("removed").over(so_far)).alias("kept")
    return found.select("part", "filter_order", "step", kept, "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
