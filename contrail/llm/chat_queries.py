"""Query on conversations: chat turns seen as tool calls and results, linked and validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.tool_calls import link_tool_calls

SCHEMAS = [
    {"name": "search", "parameters": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
        "required": ["limit", "query"], "additionalProperties": False}},
    {"name": "fetch", "parameters": {
        "properties": {"page": {"type": "string"}, "mode": {"type": "string", "enum": ["raw", "text"]}},
        "required": ["mode", "page"]}},
]


def tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations``: assistant turns call a tool, user turns behind a first answer the turn before.

    Tool, argument faults and needs follow from the length of the text, so all cases occur.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n, name = F.length("text"), F.lit("call-")
    at = lambda t: F.concat(name, t.cast("string"))
    after = F.array_compact(
        F.array(F.when(n % 2 == 0, at(F.col("turn") - 2)), F.when(n % 5 == 0, at(F.col("turn") + 2)))
    )
    tool = F.when(n % 4 < 2, "search").when(n % 4 == 2, "fetch").otherwise("forget")
    arguments = F.when(
        n % 4 < 2,
        F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 8 > 0, n % 60).alias("limit"), F.when(n % 7 == 0, True).alias("fast"))),
    ).otherwise(
        F.to_json(F.struct(F.when(n % 3 > 0, F.lit("raw")).otherwise("rare").alias("mode"), F.when(n % 9 > 0, F.col("text")).alias("page")))
    )
    calls = F.array(F.struct(at(F.col("turn")).alias("id"), tool.alias("name"), arguments.alias("arguments"), after.alias("after")))
    result = F.struct(at(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    called, answers = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    text = F.when(called, F.to_json(F.struct(calls.alias("tool_calls")))).when(answers, F.to_json(result)).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(tool_chat(spark, sf_dir), SCHEMAS)


QUERIES = {"op1_tool_calls": op1_tool_calls}
SQL = {
    "op1_tool_calls": """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, length(text) AS n,
    CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'message' END AS kind, role
  FROM conversations
), call AS (SELECT * FROM m WHERE kind = 'call'),
edge AS (
  SELECT r.conv_id, c.turn AS src, r.turn AS dst FROM m r JOIN call c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE r.kind = 'result'
  UNION ALL SELECT d.conv_id, s.turn, d.turn FROM call d JOIN call s ON s.conv_id = d.conv_id
    AND ((d.n % 2 = 0 AND s.turn = d.turn - 2) OR (d.n % 5 = 0 AND s.turn = d.turn + 2))
), above AS (
  SELECT conv_id, src AS a, dst FROM edge
  UNION SELECT e.conv_id, b.a, e.dst FROM above b JOIN edge e ON e.conv_id = b.conv_id AND e.src = b.dst
), looped AS (SELECT DISTINCT conv_id, a FROM above WHERE a = dst),
cyclic AS (
  SELECT conv_id, a AS turn FROM looped UNION SELECT b.conv_id, b.dst FROM above b JOIN looped USING (conv_id, a)
), ready AS (
  SELECT m.conv_id, m.turn, c.turn IS NOT NULL AS cyclic,
    CASE WHEN c.turn IS NOT NULL THEN m.turn ELSE greatest(m.turn, coalesce(max(b.a), m.turn)) END AS ready_turn
  FROM m LEFT JOIN above b ON b.conv_id = m.conv_id AND b.dst = m.turn LEFT JOIN cyclic c ON c.conv_id = m.conv_id AND c.turn = m.turn
  GROUP BY m.conv_id, m.turn, c.turn
), chain AS (
  SELECT conv_id, turn, ready_turn, 0 AS depth FROM ready WHERE turn = ready_turn AND NOT cyclic
  UNION SELECT r.conv_id, r.turn, r.ready_turn, chain.depth + 1 FROM chain
    JOIN edge e ON e.conv_id = chain.conv_id AND e.src = chain.turn
    JOIN ready r ON r.conv_id = e.conv_id AND r.turn = e.dst AND r.ready_turn = chain.ready_turn AND NOT r.cyclic
), depth AS (SELECT conv_id, turn, max(depth) AS depth FROM chain GROUP BY ALL),
arg AS (
  SELECT conv_id, turn, CASE WHEN n % 4 < 2 THEN 'search' WHEN n % 4 = 2 THEN 'fetch' ELSE 'forget' END AS name,
    CASE WHEN n % 4 < 2 THEN concat_ws(',', CASE WHEN n % 7 = 0 THEN 'extra:fast' END, CASE WHEN n % 8 = 0 THEN 'missing:limit' END,
        CASE WHEN n % 8 > 0 AND (n % 60 < 1 OR n % 60 > 50) THEN 'range:limit' END)
      WHEN n % 4 = 2 THEN concat_ws(',', CASE WHEN n % 3 = 0 THEN 'enum:mode' END, CASE WHEN n % 9 = 0 THEN 'missing:page' END)
      ELSE 'unknown_tool' END AS errors,
    CASE WHEN n % 4 < 2 THEN concat('{', CASE WHEN n % 7 = 0 THEN '"fast":true,' END, CASE WHEN n % 8 > 0 THEN '"limit":' || n % 60 || ',' END, '"query":', to_json(text), '}')
      ELSE concat('{"mode":', CASE WHEN n % 3 > 0 THEN '"raw"' ELSE '"rare"' END, CASE WHEN n % 9 > 0 THEN ',"page":' || to_json(text) END, '}') END AS arguments
  FROM call
)
SELECT m.conv_id, m.turn, 0 AS k, m.kind,
  CASE m.kind WHEN 'call' THEN 'call-' || m.turn WHEN 'result' THEN 'call-' || (m.turn - 1) END AS call_id,
  CASE m.kind WHEN 'message' THEN 'plain'
    WHEN 'call' THEN CASE WHEN a.turn IS NOT NULL THEN 'linked' ELSE 'unanswered' END
    ELSE CASE WHEN s.turn IS NOT NULL THEN 'linked' ELSE 'orphan' END END AS status,
  r.ready_turn, coalesce(d.depth, 0)::BIGINT AS depth, r.cyclic, arg.errors,
  CASE m.kind WHEN 'call' THEN concat('{"arguments":', arg.arguments, ',"id":"call-', m.turn, '","kind":"call","name":"', arg.name, '","role":"assistant"}')
    WHEN 'result' THEN concat('{"content":', to_json(m.text), ',"id":"call-', m.turn - 1, '","kind":"result","role":"tool"}')
    ELSE concat('{"kind":"message","role":"', m.role, '","text":', to_json(m.text), '}') END AS json
FROM m JOIN ready r USING (conv_id, turn) LEFT JOIN depth d USING (conv_id, turn) LEFT JOIN arg USING (conv_id, turn)
LEFT JOIN m a ON m.kind = 'call' AND a.kind = 'result' AND a.conv_id = m.conv_id AND a.turn = m.turn + 1
LEFT JOIN call s ON m.kind = 'result' AND s.conv_id = m.conv_id AND s.turn = m.turn - 1""",
}
