"""Closed flights to the archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail import schema
from contrail.operators.intervals import TICKS, state_intervals
from contrail.operators.qualify import (
    FLIGHT,
    flight_id,
    flight_info,
    qualify,
    thin,
    wide_series,
)
from contrail.operators.rules import Rules
from contrail.operators.slices import Width
from contrail.operators.track import (
    calculated_series,
    motion,
    received_series,
    series_chunks,
)
from contrail.sources.archive import Archive
from contrail.sources.scratch import materialize


def archive_flights(
    messages: DataFrame,
    rules: Rules,
    back_n: int = schema.BACK_N,
    fresh_seconds: float | None = None,
    max_time_s: float = schema.MAX_TIME_SECONDS,
    tie: Sequence[str] = ("hex",),
    slice_seconds: Width = schema.SLICE_SECONDS,
    step_seconds: int = 1,
) -> Archive:
    """What to archive of the flights in ``messages`` (with ``flight_start``).

    ``messages`` is read in many branches and should be a table (see ``messages_from_frames``
    or ``materialize``). States, series and qualified flights are written once each.
    """
    keys = list(FLIGHT)
    datums = [d for d in schema.RECEIVED if d in messages.columns]
    received = received_series(messages, keys, "ts", tie, datums, slice_seconds)
    motions = motion(messages, back_n, fresh_seconds, keys, "ts", tie, slice_seconds)
    states = materialize(
        motions.select(*keys, "ts", *tie, "speed", "speed_ts", "heading"), "states"
    )
    calculated = calculated_series(states, keys, "ts", tie, slice_seconds)
    series = materialize(received.unionByName(calculated), "series")
    info = materialize(flight_info(messages, keys, "ts", tie), "flights")

    part = F.col("category")
    wide = wide_series(
        series.filter(part == "received_data"), series.filter(part == "calculated_data"),
        keys, "ts", tie,
    )
    bounds = info.select(*keys, "flight_end")
    stretches = state_intervals(bounds, wide, keys, "ts", tie, step_seconds, slice_seconds)
    qualified = materialize(qualify(stretches, rules, keys, max_time_s, TICKS), "qualified")

    kept = thin(series, qualified, bounds, rules, keys, "ts", tie, slice_seconds)
    named = kept.select(
        F.lower("icao").alias("icao"), flight_id().alias("flight_id"),
        "category", "type", "ts", *tie, "value",
    )
    chunks = series_chunks(
        named, ["icao", "flight_id", "category", "type"], "ts", "value", tie, slice_seconds
    )
    about = qualified.join(info, keys).select(
        F.lower("icao").alias("icao"), flight_id().alias("flight_id"), "zone", "level",
        "callsign", "plane_category", "first_packet", "last_update", "packets", "packet_type",
    )
    return Archive(chunks.unionByName(_empty_series(chunks, about)), about)


def _empty_series(chunks: DataFrame, about: DataFrame) -> DataFrame:
    """An empty piece for every datum of a saved flight that has no sample."""
    names = F.array(*[
        F.struct(F.lit(category).alias("category"), F.lit(datum).alias("type"))
        for category, datums in (
            ("received_data", schema.RECEIVED), ("calculated_data", schema.CALCULATED)
        )
        for datum in datums
    ])
    one = ["icao", "flight_id", "category", "type"]
    return (
        about.select("icao", "flight_id", F.inline(names))
        .join(chunks.select(*one).distinct(), one, "left_anti")
        .select(
            *one,
            F.lit(None).cast("bigint").alias("chunk"),
            F.array().cast("array<struct<time:double,value:double>>").alias("data"),
        )
    )
