"""Frame sources: text lines as a receiver sends them, and tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frames_from_lines(
    lines: DataFrame, receiver: str = "main", value: str = "value", ts: str | None = None
) -> DataFrame:
    """Lines like ``*8D...;`` to frames; several per value, empties dropped.

    Without a time column the rows are stamped on arrival.
    """
    text = F.explode(F.split(F.regexp_replace(value, "[*;\r]", ""), "\n"))
    at = F.current_timestamp() if ts is None else F.col(ts)
    return (
        lines.select(at.alias("ts"), text.alias("hex"))
        .filter(F.length("hex") > 0)
        .select(F.lit(receiver).alias("receiver"), "ts", "hex")
    )


def read_frames(
    spark: SparkSession, path: str, receiver: str = "main", streaming: bool = False
) -> DataFrame:
    """Text files of receiver output, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return frames_from_lines(reader.text(path), receiver)


def union_receivers(*frames: DataFrame) -> DataFrame:
    """All receivers together."""
    return functools.reduce(DataFrame.unionByName, frames)


def _dump1090(spark: SparkSession, receiver: str, arguments: Mapping, streaming: bool) -> DataFrame:
    return read_frames(spark, arguments["path"], receiver, streaming)


# Source methods by name. A method takes (spark, receiver, arguments, streaming) and returns
# frames; add your own to use it in a configuration.
METHODS: dict[str, Callable[[SparkSession, str, Mapping, bool], DataFrame]] = {
    "dump1090": _dump1090,
}


def read_receivers(spark: SparkSession, config: Mapping, streaming: bool = False) -> DataFrame:
    """Union of every receiver of the configuration."""
    receivers = config.get("receivers") or {}
    if not receivers:
        raise ValueError("the configuration has no receivers")
    unknown = {r["method"] for r in receivers.values()} - set(METHODS)
    if unknown:
        raise ValueError(f"unknown receiver methods: {sorted(unknown)}")
    return union_receivers(*[
        METHODS[r["method"]](spark, name, r.get("arguments") or {}, streaming)
        for name, r in receivers.items()
    ])
