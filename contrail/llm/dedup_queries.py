"""Queries that find repeats: long strings, lines, SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.line_dedup import dedup_lines
from contrail.llm.simhash import near_duplicates
from contrail.llm.suffix_dedup import dedup_substrings


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, budget=4)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=400)
    # What is left, as text; a character that lost some of its bytes becomes a replacement mark there.
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept", "spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=50)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup, "op6_line_dedup": op6_line_dedup, "op8_simhash": op8_simhash}
# Every shortest run of 50 words, forwards and backwards, by its text; no suffix order needed for few rows.
SQL = {
    "op6_line_dedup": """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents
), line AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '\\S+')) AS words FROM split
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
    sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM line WHERE words > 0
), run AS (
  SELECT a.doc_id, a.n AS s, min(b.n) AS e FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.total - a.total + a.words >= 50 AND b.n >= a.n GROUP BY ALL
  UNION SELECT b.doc_id, max(a.n), b.n FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.total - a.total + a.words >= 50 AND b.n >= a.n GROUP BY b.doc_id, b.n
), named AS (
  SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY n) AS content
  FROM run r JOIN filled f ON f.doc_id = r.doc_id AND n BETWEEN s AND e GROUP BY r.doc_id, s, e
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS place FROM named) WHERE place > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM filled f JOIN later l ON l.doc_id = f.doc_id AND f.n BETWEEN s AND e
), kept AS (
  SELECT l.doc_id, count(*) FILTER (words > 0) AS n_lines, count(g.i) AS n_removed,
    string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE text END) AS kept_sha256 FROM kept""",
}
