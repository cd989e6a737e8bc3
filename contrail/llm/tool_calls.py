"""Chat formatting: link tool calls and results, order them, validate arguments, write canonical JSON.

Column expressions and joins only. Canonical JSON has sorted keys, no blanks between tokens, and
numbers as Spark's VARIANT type prints them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.sources.scratch import materialize

BROADCAST_BYTES = 8 << 20  # schemas of more bytes than this are joined by a shuffle
# JSON schema types and the VARIANT types they allow.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN",
    "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID",
}


def canonical(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def _messages(chat: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per call, result or other message. ``c`` is the conversation (null is one of its own), pos its order."""
    rows = chat.select(
        F.struct(chat[conv].alias("c")).alias("c"), chat[turn].cast("long").alias("turn"), chat[role].alias("role"),
        chat[text].alias("text"), F.monotonically_increasing_id().alias("seq"),
    )
    v = F.when(F.col("role").isin("assistant", "tool"), F.try_parse_json("text"))
    rows = rows.withColumn("v", v)
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    rows = rows.select("*", F.posexplode_outer(calls).alias("k", "call"))
    linked = (F.col("role") == "tool") & F.try_variant_get("v", "$.tool_call_id", "string").isNotNull()
    kind = F.when(F.col("call").isNotNull(), "call").when(linked, "result").otherwise("message")
    raw = F.try_variant_get("call", "$.arguments", "variant")
    inner = F.try_variant_get("call", "$.arguments", "string")  # arguments may be JSON inside a string
    args = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(inner)).otherwise(raw)
    return rows.select(
        "c", F.struct("turn", "seq", F.coalesce("k", F.lit(0)).alias("k")).alias("pos"), "role", kind.alias("kind"),
        F.when(kind == "call", F.try_variant_get("call", "$.id", "string"))
        .when(kind == "result", F.try_variant_get("v", "$.tool_call_id", "string")).alias("id"),
        F.try_variant_get("call", "$.name", "string").alias("name"), F.to_json(args).alias("arguments"),
        F.array_distinct(F.array_compact(F.try_variant_get("call", "$.after", "array<string>"))).alias("after"),
        F.when(kind == "result", F.to_json(F.try_variant_get("v", "$.content", "variant"))).alias("content"),
        F.when(kind == "message", F.col("text")).alias("text"),
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """c, pos, ready, depth, waits of the messages whose order their needs change; others keep their own place.

    Only conversations with a need that stands behind its user are sorted, in rounds: a message
    is done when all it needs is done. Messages left over lie on a cycle, or behind one.
    """
    upset = edges.filter("src >= dst").select("c").distinct()
    edges = materialize(edges.join(upset, "c", "left_semi").distinct(), "call_edges")
    wanted = edges.groupBy("c", F.col("dst").alias("pos")).agg(F.count("*").alias("needs"))
    nodes = edges.select("c", F.col("src").alias("pos")).union(edges.select("c", F.col("dst").alias("pos"))).distinct()
    state = nodes.join(wanted, ["c", "pos"], "left").select(
        "c", "pos", F.coalesce("needs", F.lit(0)).cast("long").alias("needs"),
        F.expr("CAST(NULL AS struct<ready: struct<turn: bigint, seq: bigint, k: int>, depth: bigint>)").alias("best"),
    )
    done = None
    while True:
        state = materialize(state, "call_state")
        later = F.col("best.ready") > F.col("pos")
        fresh = state.filter("needs = 0").select(
            "c", "pos", F.when(later, F.col("best.ready")).otherwise(F.col("pos")).alias("ready"),
            F.when(later, F.col("best.depth") + 1).otherwise(F.lit(0).cast("long")).alias("depth"),
        )
        if not fresh.take(1):
            break
        fresh = materialize(fresh, "call_done")
        done = fresh if done is None else done.unionByName(fresh)
        given = edges.join(fresh.withColumnRenamed("pos", "src"), ["c", "src"]).select(
            "c", F.col("dst").alias("pos"), F.lit(-1).cast("long").alias("needs"), F.struct("ready", "depth").alias("best")
        )
        state = state.filter("needs > 0").unionByName(given)
        state = state.groupBy("c", "pos").agg(F.sum("needs").alias("needs"), F.max("best").alias("best"))
    left = state.select("c", "pos", F.col("pos").alias("ready"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    return left if done is None else left.unionByName(done.withColumn("cyclic", F.lit(False)))


def _tools(spark: SparkSession, schemas: list[dict]) -> tuple[DataFrame, bool]:
    """Schemas as a table of one row per tool, and whether it is small enough to broadcast."""
    rows = []
    for s in schemas:
        p = s["parameters"]
        props = [
            {"key": k, "type": TYPES[v["type"]], "lo": v.get("minimum"), "hi": v.get("maximum"),
             "allowed": [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in v["enum"]] if "enum" in v else None}
            for k, v in p.get("properties", {}).items()
        ]
        rows.append({"tool": s["name"], "required": p.get("required", []), "open": p.get("additionalProperties", True), "props": props})
    text = json.dumps(rows)
    kind = (
        "array<struct<tool: string, required: array<string>, open: boolean, props: "
        "array<struct<key: string, type: string, lo: double, hi: double, allowed: array<string>>>>>"
    )
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind))), len(text) <= BROADCAST_BYTES


def _errors() -> Column:
    """What is wrong with the arguments of a call, sorted; needs the columns of ``_tools``."""
    v = F.try_parse_json("arguments")
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    entries = F.map_entries(F.when(object_, v).cast("map<string,variant>"))

    def wrong(e: Column) -> Column:
        p = F.try_element_at(F.filter("props", lambda x: x["key"] == e["key"]), F.lit(1))
        number = F.try_variant_get(e["value"], "$", "double")
        return (
            F.when(p.isNull(), F.when(~F.col("open"), F.concat(F.lit("extra:"), e["key"])))
            .when(~F.rlike(F.schema_of_variant(e["value"]), F.concat(F.lit("^"), p["type"], F.lit("$"))), F.concat(F.lit("type:"), e["key"]))
            .when(~F.array_contains(p["allowed"], F.to_json(e["value"])), F.concat(F.lit("enum:"), e["key"]))
            .when((number < p["lo"]) | (number > p["hi"]), F.concat(F.lit("range:"), e["key"]))
        )

    missing = F.transform(F.array_except("required", F.map_keys(F.when(object_, v).cast("map<string,variant>"))), lambda x: F.concat(F.lit("missing:"), x))
    return (
        F.when(F.col("tool").isNull(), F.array(F.lit("unknown_tool")))
        .when(v.isNull(), F.array(F.lit("not_json")))
        .when(~object_, F.array(F.lit("not_object")))
        .otherwise(F.array_sort(F.concat(missing, F.array_compact(F.transform(entries, wrong)))))
    )


def link_tool_calls(
    chat: DataFrame, schemas: list[dict], conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per call, result or plain message of ``chat``.

    A message of role ``assistant`` may be JSON with ``tool_calls``: a list of id, name, arguments
    (JSON, or JSON in a string) and ``after``, ids of calls that must come first. One of role
    ``tool`` may be JSON with ``tool_call_id`` and ``content``. All else is a plain message: other
    roles, null or empty texts, other JSON, an empty list of calls. ``schemas`` are JSON schemas:
    name and parameters (properties with type, enum, minimum, maximum; required;
    additionalProperties).

    Result: the conversation, turn, k (number of the call in its message), kind, call_id, status,
    ready_turn, depth, cyclic, errors (comma-joined, empty if valid; null if no call), json.

    Calls and results are joined by conversation and id. The first call with an id owns it:
    status is linked, unanswered, orphan (a result without call), repeated (a later call with the
    id, or a later result of a call) or plain. Sorting by (ready_turn, depth, turn, k) puts a
    message right behind the last thing it needs and otherwise keeps the order. A message on a
    cycle, or behind one, keeps its turn and is ``cyclic``. Unknown ids in ``after`` are ignored.
    Null conversations form one of their own; repeated rows stay; other columns aren't read; an
    empty table gives an empty result. No step gathers a conversation: hot ones are spread by id.
    """
    spark = chat.sparkSession
    rows = materialize(_messages(chat, conv, turn, role, text), "messages")
    owners = rows.filter("kind = 'call' and id is not null").groupBy("c", "id").agg(F.min("pos").alias("src"))
    needs = rows.filter("kind = 'result'").select("c", "id", F.col("pos").alias("dst"), F.lit(True).alias("answer"))
    after = rows.filter("kind = 'call'").select("c", F.explode("after").alias("id"), F.col("pos").alias("dst"), F.lit(False).alias("answer"))
    edges = needs.unionByName(after).join(owners.hint("shuffle_hash"), ["c", "id"])
    edges = materialize(edges, "call_links")
    answers = edges.filter("answer").groupBy("c", "id").agg(F.min("dst").alias("first_answer"))
    owners = owners.join(answers, ["c", "id"], "left")
    order = _ordered(edges.select("c", "src", "dst"))
    tools, small = _tools(spark, schemas)
    checked = rows.join(owners, ["c", "id"], "left")
    checked = materialize(checked, "linked").join(order, ["c", "pos"], "left")
    checked = checked.join(F.broadcast(tools) if small else tools, F.col("name") == F.col("tool"), "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    answered = F.when(F.col("first_answer").isNotNull(), "linked").otherwise("unanswered")
    status = (
        F.when(call & (F.col("src") != F.col("pos")), "repeated")
        .when(call, answered)
        .when(result & F.col("src").isNull(), "orphan")
        .when(result, F.when(F.col("first_answer") == F.col("pos"), "linked").otherwise("repeated"))
        .otherwise("plain")
    )
    body = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.try_parse_json("content").alias("content"),
        F.when(F.col("kind") == "message", F.col("text")).alias("text"), "id", "name", "kind", "role",
    )
    return checked.select(
        F.col("c.c").alias(conv), F.col("pos.turn").alias(turn), F.col("pos.k").alias("k"), "kind", F.col("id").alias("call_id"),
        status.alias("status"), F.coalesce("ready.turn", "pos.turn").alias("ready_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.when(call, F.array_join(_errors(), ",")).alias("errors"),
        canonical(F.to_json(body)).alias("json"),
    )
