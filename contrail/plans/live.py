"""Frames to alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from contrail import schema
from contrail.operators.alerts import alerts
from contrail.operators.enrich import with_callsign
from contrail.operators.frames import decode_messages, dedup_within, with_fields
from contrail.operators.rules import Rules, level_hits
from contrail.operators.slices import Width
from contrail.operators.track import flights, motion
from contrail.operators.zones import rule_states
from contrail.sources.scratch import materialize


def messages_from_frames(
    frames: DataFrame,
    home: tuple[float, float] = schema.HOME,
    merge_seconds: float = schema.MERGE_SECONDS,
    remember_seconds: float = schema.REMEMBER_SECONDS,
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Merged, decoded messages with their flight, written as a table.

    Flights and everything later read their input in several branches, so the costly steps
    before each are written once. The hex text is kept to order messages of equal time.
    """
    merged = dedup_within(
        frames, "hex", "ts", merge_seconds, ["receiver"], slice_seconds
    )
    decoded = materialize(decode_messages(with_fields(merged), *home, keep=["hex"]), "messages")
    return materialize(flights(decoded, "icao", "ts", remember_seconds, slice_seconds), "flights")


def state_alerts(
    states: DataFrame,
    rules: Rules,
    max_time_s: float = schema.MAX_TIME_SECONDS,
    registrations: DataFrame | None = None,
) -> DataFrame:
    """Track states to alerts; narrow, apart from an optional registration lookup."""
    hits = level_hits(rule_states(states, rules, max_time_s), rules)
    if registrations is not None:
        hits = with_callsign(hits, registrations)
    return alerts(hits)


def live_alerts(
    messages: DataFrame,
    rules: Rules,
    back_n: int = schema.BACK_N,
    fresh_seconds: float | None = None,
    max_time_s: float = schema.MAX_TIME_SECONDS,
    tie: Sequence[str] = ("hex",),
    slice_seconds: Width = schema.SLICE_SECONDS,
    registrations: DataFrame | None = None,
) -> DataFrame:
    """Alerts after every message of every flight."""
    states = motion(
        messages, back_n, fresh_seconds, ["icao", "flight_start"], "ts", tie, slice_seconds
    )
    return state_alerts(states, rules, max_time_s, registrations)
