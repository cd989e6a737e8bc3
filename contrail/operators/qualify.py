"""Which flights are archived, and which of their samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail import schema
from contrail.operators.rules import Rules, SaveMethod, requirement
from contrail.operators.slices import (
    MICROS,
    SLICE,
    US,
    across,
    Width,
    as_list,
    earlier,
    slice_id,
    sliced,
    widest,
    with_row_number,
    within,
)
from contrail.operators.track import asof_nearest
from contrail.operators.zones import rule_states

FLIGHT = ("icao", "flight_start")
MOST_TICKS = 86_400  # of one piece of a grid


def second_grid(
    bounds: DataFrame,
    start: str = "flight_start",
    end: str = "flight_end",
    step_seconds: int = 1,
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Whole seconds after ``start`` up to ``end``, as column ``ts``.

    A long flight is first split into pieces that are spread over the cluster; each piece then
    makes its own seconds.
    """
    step = step_seconds * MICROS
    piece = max(1, min(round(widest(slice_seconds) / step_seconds), MOST_TICKS))
    keep = bounds.columns
    ticks = bounds.withColumns({
        "_lo": F.floor(F.unix_micros(start) / step) + 1,
        "_hi": F.floor(F.unix_micros(end) / step),
    }).filter("_lo <= _hi")
    pieces = ticks.withColumn(
        "_piece", F.explode(F.sequence(F.floor(F.col("_lo") / piece), F.floor(F.col("_hi") / piece)))
    ).repartition(*keep, "_piece")
    first = F.greatest(F.col("_lo"), F.col("_piece") * piece)
    last = F.least(F.col("_hi"), F.col("_piece") * piece + piece - 1)
    return pieces.withColumn("_tick", F.explode(F.sequence(first, last))).select(
        *keep, F.timestamp_micros(F.col("_tick") * step).alias("ts")
    )


def wide_series(received: DataFrame, calculated: DataFrame, keys: Sequence[str], ts: str = "ts",
                tie: Sequence[str] = ()) -> DataFrame:
    """Long series to sparse columns: received datums by name, calculated speed and heading."""
    rows = received.select(*keys, "category", "type", ts, *tie, "value").unionByName(
        calculated.select(*keys, "category", "type", ts, *tie, "value")
    )

    def column(category: str, datum: str, name: str) -> Column:
        return F.when(
            (F.col("category") == category) & (F.col("type") == datum), F.col("value")
        ).alias(name)

    return rows.select(
        *keys,
        ts,
        *tie,
        *[
            column("received_data", d, d)
            for d in ("latitude", "longitude", "altitude", "vertical_speed")
        ],
        column("calculated_data", "horizontal_speed", "speed"),
        column("calculated_data", "direction", "heading"),
    )


def second_states(
    bounds: DataFrame, series: DataFrame, keys: Sequence[str] = FLIGHT, ts: str = "ts",
    tie: Sequence[str] = (), step_seconds: int = 1,
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Nearest-in-time state at every second of every flight that can be judged.

    A flight without a position or a calculated heading has nothing to judge and drops out.
    """
    grid = second_grid(bounds, step_seconds=step_seconds, slice_seconds=slice_seconds)
    cols = ["latitude", "longitude", "altitude", "vertical_speed", "speed", "heading"]
    states = asof_nearest(
        grid.select(*keys, "ts"), series.withColumnRenamed(ts, "ts"), keys, "ts", cols, tie,
        slice_seconds,
    )
    return states.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("heading").isNotNull()
    )


def qualify(
    states: DataFrame,
    rules: Rules,
    keys: Sequence[str] = FLIGHT,
    max_time_s: float = schema.MAX_TIME_SECONDS,
    weight: str | None = None,
) -> DataFrame:
    """Levels a flight met for at least their number of seconds.

    The time to enter is computed once per zone that has levels, the distance only to zones whose
    levels ask for it, and all levels are counted in one aggregation that is combined map-side. ``weight`` names the number of seconds that a state
    stands for, if it is not one.
    """
    keys = as_list(keys)
    rules = rules.with_levels()
    judged = rule_states(states, rules, max_time_s, rules.distance_zones)
    stands = F.col(weight) if weight else F.lit(1)
    counts = [
        F.sum(
            F.when((F.col("zone") == v.zone) & requirement(v.requirements, rules.components), stands)
        ).alias(f"_n{i}")
        for i, v in enumerate(rules.levels)
    ]
    per_zone = judged.groupBy(*keys, "zone").agg(F.min("eta").alias("min_eta"), *counts)
    met = F.array_compact(
        F.array(*[
            F.when(
                (F.col("zone") == v.zone) & (F.col(f"_n{i}") >= v.seconds),
                F.struct(
                    F.lit(i).alias("level_no"),
                    F.lit(v.name).alias("level"),
                    F.col(f"_n{i}").alias("valid_seconds"),
                ),
            )
            for i, v in enumerate(rules.levels)
        ])
    )
    return per_zone.select(*keys, "zone", "min_eta", F.inline(met))


def decimate(
    series: DataFrame, keys: Sequence[str], ts: str, n: int, tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Every n-th row of each series, starting with the first."""
    rows = with_row_number(sliced(series, ts, slice_seconds), as_list(keys), tie, "_nth")
    return rows.filter((F.col("_nth") - 1) % n == 0).select(*series.columns)


def _numbered_in_buckets(rows: DataFrame, keys: list[str], spans: dict[str, float], tie: Sequence[str] = ()) -> DataFrame:
    """Add for every name in ``spans`` the 1-based number of the row within its bucket of so many seconds.

    Buckets count from the first row of the series. Of the buckets in a slice only the first can
    have rows in earlier slices, so one small row per slice says what enters it: rows keep their
    place, whatever the number of spans.
    """
    starts = rows.groupBy(*keys, SLICE).agg(F.min(US).alias("_first"))
    everything = across(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts.select(*keys, SLICE, F.min("_first").over(everything).alias("_t0"))
    rows = rows.join(starts, [*keys, SLICE], "left")
    for name, seconds in spans.items():
        rows = rows.withColumn(f"_in{name}", F.floor((F.col(US) - F.col("_t0")) / round(seconds * MICROS)))
    for name in spans:
        bucket = f"_in{name}"
        sizes = rows.groupBy(*keys, SLICE, bucket).agg(F.count(F.lit(1)).alias("_rows"))
        offset = F.coalesce(F.sum("_rows").over(earlier([*keys, bucket])), F.lit(0))
        entering = sizes.select(*keys, SLICE, bucket, offset.alias("_before"))
        entering = entering.groupBy(*keys, SLICE).agg(
            F.min(bucket).alias("_open"), F.min_by("_before", bucket).alias("_before")
        )
        first = F.col(bucket) == F.col("_open")  # unknown for a row without a key or time, which gets no number
        rows = (
            rows.withColumn("_local", F.row_number().over(within([*keys, bucket], tie)))
            .join(entering, [*keys, SLICE], "left")
            .withColumn(name, F.col("_local") + F.when(first, F.col("_before")).when(~first, 0))
            .drop("_local", "_open", "_before")
        )
    return rows.drop("_t0", *[f"_in{name}" for name in spans])


def sdecimate(
    series: DataFrame, keys: Sequence[str], ts: str, count: int, seconds: float,
    tie: Sequence[str] = (), slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """At most ``count`` rows per ``seconds``-long bucket of each series."""
    rows = _numbered_in_buckets(sliced(series, ts, slice_seconds), as_list(keys), {"_nth": seconds}, tie)
    return rows.filter(F.col("_nth") <= count).select(*series.columns)


def thin(
    series: DataFrame,
    qualified: DataFrame,
    bounds: DataFrame,
    rules: Rules,
    keys: Sequence[str] = FLIGHT,
    ts: str = "ts",
    tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Samples to archive: each series once per qualified (zone, level), by its save rule.

    ``bounds`` gives each flight's ``flight_start`` and ``flight_end``; the qualified levels
    are handed to every slice of their flight, so a long flight is not joined in one task. That
    comes first: samples of flights that did not qualify are neither numbered nor shuffled again.
    """
    keys = as_list(keys)
    one = [*keys, "category", "type"]
    methods = {
        m for v in rules.levels for part in (v.telemetry, v.calculated) for m in part.values()
    }

    def number(c: str) -> Column:
        return slice_id(F.unix_micros(c), slice_seconds)

    # A calculated sample can carry the time of an older speed, never one before the flight.
    spread = (
        qualified.groupBy(*keys)
        .agg(F.collect_set("level_no").alias("_levels"))
        .join(bounds.select(*keys, "flight_end"), keys)
        .withColumn(
            SLICE, F.explode(F.sequence(number("flight_start"), number("flight_end")))
        )
        .drop("flight_end")
    )
    rows = sliced(series, ts, slice_seconds).join(spread, [*keys, SLICE])
    if any(m.kind == "decimate" for m in methods):
        rows = with_row_number(rows, one, tie, "_nth")
    spans = sorted({m.seconds for m in methods if m.kind == "sdecimate"})
    if spans:
        rows = _numbered_in_buckets(rows, one, {f"_nth{i}": seconds for i, seconds in enumerate(spans)}, tie)

    def keeps(m: SaveMethod) -> Column:
        if m.kind == "decimate":
            return (F.col("_nth") - 1) % m.count == 0
        if m.kind == "sdecimate":
            return F.col(f"_nth{spans.index(m.seconds)}") <= m.count
        return F.lit(m.kind == "all")

    def rule(part: dict[str, SaveMethod]) -> Column:
        chosen = keeps(part["default"])
        for datum, method in part.items():
            if datum != "default":
                chosen = F.when(F.col("type") == datum, keeps(method)).otherwise(chosen)
        return chosen

    saved = F.array_compact(
        F.array(*[
            F.when(
                F.array_contains("_levels", i)
                & F.when(F.col("category") == "received_data", rule(v.telemetry)).otherwise(
                    rule(v.calculated)
                ),
                F.struct(F.lit(v.zone).alias("zone"), F.lit(v.name).alias("level")),
            )
            for i, v in enumerate(rules.levels)
        ])
    )
    return rows.select(*series.columns, F.inline(saved))


def flight_info(
    messages: DataFrame, keys: Sequence[str] = FLIGHT, ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """One row per flight: counters, packet type histogram, callsign and category."""
    keys = as_list(keys)
    at = F.struct(ts, *tie)
    kinds = range(6)
    counted = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        F.max_by("callsign", F.when(F.col("callsign").isNotNull(), at)).alias("callsign"),
        F.max_by(
            F.array("cat_tc", "cat_ca"), F.when(F.col("cat_tc").isNotNull(), at)
        ).alias("plane_category"),
        *[F.count_if(F.col("type_cat") == k).alias(f"_k{k}") for k in kinds],
    )
    histogram = F.map_filter(
        F.create_map(*[x for k in kinds for x in (F.lit(str(k)), F.col(f"_k{k}"))]),
        lambda _, n: n > 0,
    )
    return counted.select(
        *keys,
        "callsign",
        "plane_category",
        (F.unix_micros("_first") / 1e6).alias("first_packet"),
        (F.unix_micros("_last") / 1e6).alias("last_update"),
        "packets",
        histogram.alias("packet_type"),
        F.col("_last").alias("flight_end"),
    )


def flight_id(first: str = "flight_start") -> Column:
    """``<whole second of the first packet>-<zone>-<level>``."""
    second = F.floor(F.unix_micros(first) / MICROS).cast("string")
    return F.concat_ws("-", second, "zone", "level")
