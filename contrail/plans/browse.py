"""Archive queries: every verb of the archive shell as a function that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.enrich import first_match, with_category_label
from contrail.sources.archive import Archive

# Bytes of one stored (time, value) pair (fixed value).
PAIR_BYTES = 16


def archive_status(archive: Archive) -> DataFrame:
    """Aircraft, flights and size of the stored pairs, in one row."""
    counts = (
        archive.info.groupBy("icao", "flight_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("icao")
        .agg(F.count(F.lit(1)).alias("flights"))
        .agg(
            F.count(F.lit(1)).alias("planes"),
            F.coalesce(F.sum("flights"), F.lit(0)).alias("flights"),
        )
    )
    size = archive.series.agg(
        F.coalesce(F.sum(F.size("data") * PAIR_BYTES), F.lit(0)).alias("bytes")
    )
    # Two one-row results side by side.
    return counts.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one").drop("_one")


def list_planes(archive: Archive) -> DataFrame:
    return archive.info.groupBy("icao").agg(F.count_distinct("flight_id").alias("flights"))


def list_flights(archive: Archive, icao: str | None = None) -> DataFrame:
    rows = archive.info if icao is None else archive.info.filter(F.col("icao") == icao)
    return rows.select("icao", "flight_id").distinct()


def _newest(archive: Archive) -> DataFrame:
    at = F.struct("first_packet", "flight_id")
    cols = ["flight_id", "callsign", "plane_category", "first_packet", "last_update", "packet_type"]
    return (
        archive.info.groupBy("icao")
        .agg(F.max_by(F.struct(*cols), at).alias("_row"))
        .select("icao", "_row.*")
    )


def plane_card(
    archive: Archive, registry: DataFrame, icao: str | None = None, order: str = "line_no"
) -> DataFrame:
    """Newest flight of each aircraft with its registry entry."""
    rows = _newest(archive)
    if icao is not None:
        rows = rows.filter(F.col("icao") == icao)
    listed = first_match(registry, order=order).select(
        "icao",
        F.col("callsign").alias("registry_callsign"),
        "country", "built", "manufacturer_icao", "manufacturer_name", "model", "owner",
    )
    return (
        rows.withColumn("duration", F.col("last_update") - F.col("first_packet"))
        .drop("plane_category")
        .join(listed, "icao", "left")
    )


def plane_summary(archive: Archive, icao: str | None = None) -> DataFrame:
    """Flights, storage, category, first and last seen, packet breakdown recent and overall."""
    info, series = archive.info, archive.series
    if icao is not None:
        info, series = info.filter(F.col("icao") == icao), series.filter(F.col("icao") == icao)
    # One flight can be saved under several zones and levels: count its packets once.
    once = info.dropDuplicates(["icao", "first_packet"])
    overall = (
        once.select("icao", F.explode("packet_type").alias("kind", "n"))
        .groupBy("icao", "kind")
        .agg(F.sum("n").alias("n"))
        .groupBy("icao")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("packet_type_overall"))
    )
    totals = info.groupBy("icao").agg(
        F.count_distinct("flight_id").alias("flights"),
        F.min("first_packet").alias("first_seen"),
        F.max("last_update").alias("last_seen"),
    )
    storage = series.groupBy("icao").agg(F.sum(F.size("data") * PAIR_BYTES).alias("bytes"))
    newest = _newest(Archive(series, info)).select(
        "icao", "callsign",
        F.col("plane_category")[0].alias("cat_tc"), F.col("plane_category")[1].alias("cat_ca"),
        (F.col("last_update") - F.col("first_packet")).alias("last_duration"),
        F.col("packet_type").alias("packet_type_recent"),
    )
    cards = totals.join(newest, "icao").join(storage, "icao", "left").join(overall, "icao", "left")
    return with_category_label(cards).withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def dump(archive: Archive, icao: str | None = None, flight_id: str | None = None) -> DataFrame:
    """Raw content nested as category -> datum -> pairs, one row per flight, category, piece.

    All flights, those of one aircraft, or one flight. The information of a flight is the row
    with category ``info``.
    """
    def chosen(df: DataFrame) -> DataFrame:
        if icao is not None:
            df = df.filter(F.col("icao") == icao)
        return df if flight_id is None else df.filter(F.col("flight_id") == flight_id)

    content = (
        chosen(archive.series)
        .groupBy("icao", "flight_id", "category", "chunk")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "data")))).alias("content")
        )
    )
    info = chosen(archive.info)
    fields = [c for c in info.columns if c not in ("icao", "flight_id")]
    about = info.select(
        "icao", "flight_id", F.lit("info").alias("category"), F.struct(*fields).alias("info")
    )
    return content.unionByName(about, allowMissingColumns=True)


def dump_registry(registry: DataFrame, icao: str | None = None, order: str = "line_no") -> DataFrame:
    rows = registry if icao is None else registry.filter(F.lower("icao") == icao.lower())
    return first_match(rows, order=order)


def without_plane(archive: Archive, icao: DataFrame) -> Archive:
    """The archive without the aircraft listed in ``icao``."""
    gone = icao.select("icao").distinct()
    return Archive(
        archive.series.join(gone, "icao", "left_anti"), archive.info.join(gone, "icao", "left_anti")
    )
