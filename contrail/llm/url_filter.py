"""URL filters: pattern rules indexed by their rarest literal token. Column expressions and joins only."""

from __future__ import annotations

import json
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20  # an index of more bytes than this is joined by a shuffle


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path together; every match holds all ``tokens`` as whole ones.

    Tokens are what lies between dots and slashes. A rule with a ``name`` decides by itself, the
    one of the greatest ``weight`` first; the others are asked where no named rule matches.
    """

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    name: str | None = None
    weight: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains, for paths that start with ``path``; longer ones win."""
    whole = re.split("[./]", path)[:-1]  # the last piece may go on in the url
    tokens = tuple(sorted({*host.split("."), *whole} - {""}))
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}(?=/|$){re.escape(path)}"
    return Rule(verdict, pattern, tokens, host + path, len(host + path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host after the first ``://`` and the path behind it; both empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _table(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, bool]:
    """The rules as a table, and whether they are small enough to broadcast."""
    rows = [
        {"id": i, "verdict": r.verdict, "pattern": r.pattern, "tokens": r.tokens or [""], "rule": r.name, "weight": r.weight}
        for i, r in enumerate(rules)
    ]
    text = json.dumps(rows)
    kind = "array<struct<id: int, verdict: string, pattern: string, tokens: array<string>, rule: string, weight: int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind))), len(text) <= BROADCAST_BYTES


def judge_urls(
    pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: ``key``, host, path, rule (name, else null) and verdict.

    Among matching named rules the heaviest decides, then the first by name. Without one, an
    unnamed rule decides, ``block`` before ``allow``, and without that ``default``. Each different
    url is judged once: its tokens fetch the rules that have them as their rarest one (by the
    number of different urls that hold it, then by name), and only those rules run their pattern.
    A null url, or one without ``://``, has an empty host and path. Repeated rows and null keys
    stay; other columns aren't read; an empty table gives an empty result; no rules are allowed.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("u"))
    rows = pages.select(pages[key].alias("k"), pages[url].alias("u"))
    urls = rows.select("u").filter("u is not null").distinct().select("u", F.concat(host, path).alias("subject"))
    tokens = F.array_distinct(F.concat(F.split("subject", r"[./]"), F.array(F.lit(""))))
    held = urls.select("u", "subject", F.explode(tokens).alias("token"))
    table, small = _table(spark, rules)
    hint = F.broadcast if small else (lambda df: df)
    own = table.select("id", F.explode("tokens").alias("token"))
    often = held.join(hint(own.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(often, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("least")
    )
    index = table.join(rarest, "id").select(F.col("least.token").alias("token"), "verdict", "pattern", "rule", "weight")
    fits = held.join(hint(index), "token").filter(F.expr("subject rlike pattern"))
    named = F.when(F.col("rule").isNotNull(), F.struct((-F.col("weight")).alias("w"), "rule", "verdict"))
    other = F.max(F.when(F.col("rule").isNull(), F.col("verdict")))  # block comes after allow
    found = fits.groupBy("u").agg(F.min(named).alias("best"), other.alias("other"))
    return rows.join(found, "u", "left").select(
        F.col("k").alias(key),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", "other", F.lit(default)).alias("verdict"),
    )
