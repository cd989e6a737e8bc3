"""Flight archive: Parquet tables of series pieces and flight information, in versions.

Rows lie in folders that are never changed, split by ``icao_block`` (the first two digits of the
address: at most 256, where one folder per aircraft would be hundreds of thousands). Inside, rows
are range-clustered by aircraft, so file statistics find one aircraft and a very busy one is spread
over several files. A version is a small table that lists the blocks of folders that count; it is
written whole and under a new number, so a reader sees one version. A writer that finds its number
taken starts again from the other's version (two that begin at the very same moment need a lock of
their own: file systems differ there). Deleting an aircraft and compacting write the blocks they
touch anew, ``vacuum`` frees what no version of the last ones lists. A flight saved more than once
counts as it was saved last.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

SERIES = (
    "icao string, flight_id string, category string, type string, chunk bigint, "
    "data array<struct<time:double,value:double>>"
)
INFO = (
    "icao string, flight_id string, zone string, level string, callsign string, "
    "plane_category array<int>, first_packet double, last_update double, packets bigint, "
    "packet_type map<string,bigint>"
)
_STORED = ", saved_at timestamp, save_id string, folder string, icao_block string"
VERSION = "name string, save_id string, folder string, icao_block string"  # partitioned by version
TABLES = {"series": (SERIES, ["icao", "flight_id", "type", "chunk"]), "info": (INFO, ["icao", "flight_id"])}
MERGED = ""  # save_id of an entry that holds rows of several saves


@dataclass(frozen=True)
class Archive:
    series: DataFrame
    info: DataFrame


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, ascending."""
    try:
        found = spark.read.schema(f"{VERSION}, version bigint").parquet(f"{path}/versions")
        return sorted(r.version for r in found.select("version").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _put_version(spark: SparkSession, path: str, number: int, entries: list[tuple], mode: str) -> None:
    rows = [*entries, ("", "", "", "")]  # a version without a block has a row, too
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode(mode).parquet(f"{path}/versions/version={number}")


def _entries(spark: SparkSession, path: str, number: int | None = None) -> list[tuple]:
    """Blocks that a version lists, the newest one if no number is given: name, save_id, folder, block."""
    number = max(_versions(spark, path), default=0) if number is None else number
    rows = spark.read.schema(VERSION).parquet(f"{path}/versions/version={number}").collect() if number else []
    return [tuple(r) for r in rows if r.name]


def _commit(spark: SparkSession, path: str, change: Callable[[list[tuple]], list[tuple]], tries: int = 20) -> int:
    """Make a version of the newest one's entries. A writer that finds its number taken starts again from the other's."""
    for _ in range(tries):
        now = max(_versions(spark, path), default=0)
        try:
            _put_version(spark, path, now + 1, change(_entries(spark, path, now)), "error")
            return now + 1
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise RuntimeError(f"no version of {path} could be written in {tries} tries")


def _put(df: DataFrame, path: str, name: str) -> tuple[list[tuple], int]:
    """Write rows (with saved_at and save_id) into a new folder; its (folder, block) pairs and the number of rows."""
    spark, order, folder, seen = df.sparkSession, TABLES[name][1], uuid.uuid4().hex, Observation()
    placed = df.withColumn("icao_block", F.substring("icao", 1, 2)).repartitionByRange(*order)
    placed = placed.sortWithinPartitions(*order).observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set("icao_block").alias("blocks"))
    placed.write.partitionBy("icao_block").parquet(f"{path}/{name}/folder={folder}")
    return [(folder, block) for block in seen.get["blocks"]], seen.get["n"]


def write_archive(archive: Archive, path: str, save_id: str) -> int:
    """Write one save; writing the same ``save_id`` again replaces all of it. Returns the number of saved flights.

    The number is observed while the rows are written, so nothing is read twice.
    """
    spark, new = archive.info.sparkSession, []
    for name, df in (("series", archive.series), ("info", archive.info)):
        rows = df.withColumns({"saved_at": F.current_timestamp(), "save_id": F.lit(save_id)})
        blocks, saved = _put(rows, path, name)
        new += [(name, save_id, *b) for b in blocks]
    again = [e for e in _entries(spark, path) if e[1] == MERGED]
    if again:
        _rewrite(spark, path, {e[3] for e in again}, lambda rows: rows.filter(F.col("save_id") != save_id), merged=True)
    _commit(spark, path, lambda old: [e for e in old if e[1] != save_id] + new)
    return saved


def _rows(spark: SparkSession, path: str, name: str, entries: list[tuple]) -> DataFrame:
    """Rows of the listed blocks of one table."""
    schema = TABLES[name][0] + _STORED
    paths = [f"{path}/{name}/folder={folder}/icao_block={block}" for n, _, folder, block in entries if n == name]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*paths)


def read_archive(spark: SparkSession, path: str, icao: str | None = None, version: int | None = None) -> Archive:
    """All saved flights, or those of one aircraft from its block only; the latest save of a flight counts."""
    entries = _entries(spark, path, version)
    if icao is not None:
        entries = [e for e in entries if e[3] == icao[:2]]
    series, info = (_rows(spark, path, name, entries) for name in TABLES)
    if icao is not None:
        series, info = (df.filter(F.col("icao") == icao) for df in (series, info))
    flight = ["icao", "flight_id"]
    latest = info.groupBy(*flight).agg(F.max_by("save_id", F.struct("saved_at", "save_id")).alias("save_id"))
    series, info = (df.join(latest, [*flight, "save_id"], "left_semi") for df in (series, info))
    return Archive(*(df.drop("saved_at", "save_id", "folder", "icao_block") for df in (series, info)))


def _rewrite(spark: SparkSession, path: str, blocks: set[str], change: Callable[[DataFrame], DataFrame], merged: bool = False) -> int:
    """A version in which the rows of some blocks have been changed; they are read and written by blocks, nothing else is.

    With ``merged`` only what was compacted before is taken. Entries that another writer adds
    meanwhile stay as they are.
    """
    entries = _entries(spark, path)
    touched = [e for e in entries if e[3] in blocks and (e[1] == MERGED or not merged)]
    new = []
    for name in TABLES:
        rows = change(_rows(spark, path, name, touched)).drop("folder", "icao_block")
        new += [(name, MERGED, *b) for b in _put(rows, path, name)[0]]
    return _commit(spark, path, lambda old: [e for e in old if e not in touched] + new)


def drop_plane(spark: SparkSession, path: str, icao: str, confirm: bool = False) -> int:
    """Delete one aircraft: its block is written without it. The bytes go with the next ``vacuum``. Returns the version."""
    if not confirm:
        raise ValueError("pass confirm=True to delete the aircraft")
    return _rewrite(spark, path, {icao[:2]}, lambda rows: rows.filter(F.col("icao") != icao))


def compact(spark: SparkSession, path: str, most: int = 8) -> int | None:
    """Put the many small folders of a block together where it has more than ``most``; superseded saves of a flight go."""
    count = Counter(e[3] for e in _entries(spark, path) if e[0] == "info")
    blocks = {b for b, n in count.items() if n > most}
    if not blocks:
        return None
    newest = Window.partitionBy("icao", "flight_id").orderBy(F.desc("saved_at"), F.desc("save_id"))
    last = lambda rows: rows.withColumn("_n", F.dense_rank().over(newest)).filter("_n = 1").drop("_n")
    return _rewrite(spark, path, blocks, last)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Free what the last ``keep`` versions don't list, and the older versions; returns the number of freed blocks.

    A freed block is overwritten with an empty file. Readers of an older version must be done.
    """
    numbers = _versions(spark, path)
    current = {(n, f, b) for v in numbers[-keep:] for n, _, f, b in _entries(spark, path, v)}
    freed = {(n, f, b) for v in numbers[:-keep] for n, _, f, b in _entries(spark, path, v)} - current
    for name, folder, block in sorted(freed):
        empty = spark.createDataFrame([], TABLES[name][0] + ", saved_at timestamp, save_id string").coalesce(1)
        empty.write.mode("overwrite").parquet(f"{path}/{name}/folder={folder}/icao_block={block}")
    for v in numbers[:-keep]:
        _put_version(spark, path, v, [], "overwrite")
    return len(freed)


def reset_archive(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Empty the whole archive."""
    if not confirm:
        raise ValueError("pass confirm=True to empty the archive")
    _commit(spark, path, lambda old: [])
    vacuum(spark, path)
