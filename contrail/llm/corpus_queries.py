"""Queries on whole corpora: sharding, collocations, filter audit."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from contrail.llm.collocations import collocations
from contrail.llm.filter_audit import audit_filters
from contrail.llm.hash_tree import PIECE, Shard, even_tree, place_documents

TREE = even_tree(8)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place_documents(docs, TREE, [*TREE, Shard("r2", "k4", 8)])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level(name: str, source: str, nodes: str, above: str) -> str:
    """Rows of ``source`` with the child that wins among those of ``nodes`` below their node ``above``."""
    return f"""{name} AS (
  SELECT id, arg_min(c.node, {{'d': -ln((('0x' || substr(md5(id || '/' || c.node), 1, 12))::BIGINT + 0.5) / 281474976710656) / c.w, 'n': c.node}}) AS node
  FROM {source} p JOIN {nodes} c ON c.up = {above} GROUP BY id
)"""


def _nodes(tree: list[Shard]) -> str:
    weight: dict[tuple[str, str], float] = {}
    for x in tree:
        for up, node in (("", x.region), (x.region, f"{x.region}/{x.rack}"), (f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")):
            weight[up, node] = weight.get((up, node), 0) + x.weight
    return ", ".join(f"('{up}', '{node}', {w}::DOUBLE)" for (up, node), w in weight.items())


LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
QUERIES = {"op11_sharding": op11_sharding, "op12_collocations": op12_collocations, "op13_filter_audit": op13_filter_audit}
SQL = {
    "op11_sharding": f"""
WITH old(up, node, w) AS (VALUES {_nodes(TREE)}),
new(up, node, w) AS (VALUES {_nodes([*TREE, Shard("r2", "k4", 8)])}),
cell AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)
), doc AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce([('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, cell
), root AS (SELECT DISTINCT id FROM doc),
{_level("o1", "root", "old", "''")}, {_level("o2", "o1", "old", "p.node")}, {_level("o3", "o2", "old", "p.node")},
{_level("n1", "root", "new", "''")}, {_level("n2", "n1", "new", "p.node")}, {_level("n3", "n2", "new", "p.node")},
piece AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, crc) - 1) // {PIECE} AS piece FROM doc
), placed AS (
  SELECT p.*, md5(id || '|' || size || '|' || crc || '|' || piece) AS h,
    split_part(o3.node, '/', 3)::INTEGER AS shard, split_part(n3.node, '/', 3)::INTEGER AS grown_shard
  FROM piece p JOIN o3 USING (id) JOIN n3 USING (id)
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, crc, piece) - 1 AS slot, grown_shard
FROM placed""",
    "op12_collocations": rf"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM piece, (VALUES (1), (2), (3)) AS v(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL
), candidate AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, l.a AS l, r.a AS r, j, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) c
  JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.w[j + 1:], ' ')
), least AS (
  SELECT lang, k, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, {{'score': score, 'j': j}}) AS c FROM cut GROUP BY ALL
), longer AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS over FROM candidate, (VALUES (1), (2)) AS t(i) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY c.score DESC, a DESC, b.phrase) AS rank
  FROM least b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE over IS NULL OR 100 * over < 50 * a
)
SELECT lang, rank, phrase, a, c.l AS l, c.r AS r, n::BIGINT AS n, c.score::BIGINT AS score
FROM kept JOIN (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000""",
    "op13_filter_audit": r"""
WITH label AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM doc LEFT JOIN label USING (doc_id)
), kind AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL
), letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), step AS (
  SELECT o, s, o[s:s] AS f, o[:s - 1] AS before FROM orders, unnest(range(1, 6)) AS t(s)
), met AS (
  SELECT k.*, o, s, f, contains(fails, f) AS hit, translate(fails, before, '') = fails AS there FROM kind k, step
), total AS (
  SELECT part, o, s, f, coalesce(sum(n) FILTER (there AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (there AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (there AND hit AND good), 0) AS good_lost, coalesce(sum(n) FILTER (there AND hit AND toxic), 0) AS toxic_lost
  FROM met GROUP BY part, o, s, f
)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM total""",
}
