"""Sharding by a hierarchical weighted hash tree. Column expressions, grouping and windows only.

A row descends region, rack and shard. At each node the children draw: a hash of key and child
gives a number in (0, 1), and the least -ln(number) / weight wins, so a child is chosen in
proportion to its weight. A draw depends on its child alone: where a weight changes, rows move
only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3  # hex digits of a row's hash that name its bucket inside a shard
PIECE = 4096  # identical rows numbered together
MOST_LEAVES = 100_000  # the tree travels in the plan as a constant
_LEAF = "struct<node:string,weight:double,shard:int>"
_RACK = f"struct<node:string,weight:double,children:array<{_LEAF}>>"
_ROOT = f"array<struct<node:string,weight:double,children:array<{_RACK}>>>"


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: where the shard stands and how much of the rows it should take."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, per_region: int = 2) -> list[Shard]:
    """``shards`` equal leaves, ``per_rack`` to a rack and ``per_region`` racks to a region."""
    return [Shard(f"r{i // (per_rack * per_region)}", f"k{i // per_rack}", i) for i in range(shards)]


def _nested(tree: Sequence[Shard]) -> list[dict]:
    """Regions with their racks with their shards; a weight is the sum of what is below it."""
    if not 0 < len(tree) <= MOST_LEAVES or len({x.shard for x in tree}) < len(tree) or min(x.weight for x in tree) < 0:
        raise ValueError(f"a tree has 1 to {MOST_LEAVES} different shards with weights of 0 or more")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for x in tree:
        if x.weight:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    if not regions:
        raise ValueError("no shard has a weight above 0")
    out = []
    for region, racks in regions.items():
        below = []
        for rack, leaves in racks.items():
            ends = [{"node": f"{region}/{rack}/{x.shard}", "weight": x.weight, "shard": x.shard} for x in leaves]
            below.append({"node": f"{region}/{rack}", "weight": sum(x.weight for x in leaves), "children": ends})
        out.append({"node": region, "weight": sum(x["weight"] for x in below), "children": below})
    return out


def _winner(children: Column, key: Column) -> Column:
    """The child of least draw; equal draws go to the first by name."""

    def drawn(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), child["node"]).cast("binary")), 1, 12)
        number = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.struct((-F.ln(number) / child["weight"]).alias("draw"), child["node"].alias("node"), child.alias("child"))

    return F.array_min(F.transform(children, drawn))["child"]


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """Shard of ``key`` (text), which with the tree alone decides it. A null key draws like the empty text."""
    key = F.coalesce(key, F.lit(""))
    regions = F.from_json(F.lit(json.dumps(_nested(tree))), _ROOT)
    return _winner(_winner(_winner(regions, key)["children"], key)["children"], key)["shard"]


def place_documents(
    docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None,
    key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Shard and slot of every row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard, carried.

    The law is ``key``: key and tree decide the shard, so rows of one key stay together and equal
    texts with different keys need not. ``grown_shard`` is the shard in the tree ``grown``; if that
    has the same leaves and further ones in a region of their own, rows move only into these. Slots
    number the rows of a shard without gaps from 0, in an order by hash. Size is the text's UTF-8
    bytes and one; a null text is empty, also for text_crc32. Null keys are one more key; repeated
    rows stay, each with a slot of its own; of other columns only those in ``carry`` are read, and
    come along as the struct carried (no maps); an empty table gives an empty result.

    Identical rows travel as one row with a count, in pieces of bounded size that are spread by
    hash, so neither a hot key nor a hot text meets in one task: a window holds one bucket of a
    shard, or one row for each bucket.
    """
    content = F.coalesce(docs[text], F.lit("")).cast("binary")
    extra = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    size = (F.octet_length(content) + 1).cast("long")
    rows = docs.select(docs[key].alias("key"), size.alias("size"), F.crc32(content).alias("crc"), *extra)
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    pieces = same.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))))
    pieces = pieces.withColumn("n", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("long"))
    name = F.col("key").cast("string")
    parts = [F.coalesce(name, F.lit("")), "size", "crc", "piece"] + [F.xxhash64("carried")] * len(extra)
    spread = F.md5(F.concat_ws("|", *parts).cast("binary"))
    wider = shard_of(name, grown) if grown else F.lit(None).cast("int")
    placed = pieces.withColumns({"h": spread, "shard": shard_of(name, tree), "grown": wider})
    placed = placed.withColumn("bucket", F.substring("h", 1, DIGITS))
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "key", "size", "crc", "piece", *["carried"] * len(extra))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(inside), F.lit(0))
    numbered = placed.withColumn("first", first).join(sums, ["shard", "bucket"]).withColumn("first", F.col("base") + F.col("first"))
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return numbered.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        slot.alias("slot"), F.col("grown").alias("grown_shard"), *["carried"] * len(extra),
    )


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write placed rows as one folder for each shard, ``rows_per_file`` consecutive slots to a file, in slot order."""
    part = F.expr(f"slot div {rows_per_file}")
    spread = placed.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
    spread.drop("part").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
