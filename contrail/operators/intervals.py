"""Flights as stretches of constant state, instead of a row for every second.

The nearest value of a series changes half way between two of its samples. These switching points
of all columns cut a flight into stretches over which every column keeps its value; a stretch
counts for as many ticks as lie in it. So the rows follow the samples, not the duration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail import schema
from contrail.operators.slices import MICROS, SLICE, US, Width, across, as_list, earlier, slice_id, so_far, within

STATE = ("latitude", "longitude", "altitude", "vertical_speed", "speed", "heading")
TICKS = "ticks"


def _up(us: Column, step: int) -> Column:
    """Number of the first tick at or after a time in microseconds."""
    x = us + (step - 1)
    return ((x - F.pmod(x, F.lit(step))) / step).cast("bigint")


def state_intervals(
    bounds: DataFrame, series: DataFrame, keys: Sequence[str], ts: str = "ts", tie: Sequence[str] = (),
    step_seconds: int = 1, slice_seconds: Width = schema.SLICE_SECONDS, columns: Sequence[str] = STATE,
    needed: Sequence[str] = ("latitude", "longitude", "heading"),
) -> DataFrame:
    """What ``second_states`` gives, with equal neighbours as one row: keys, ts (first tick), columns, ticks.

    Ticks are the multiples of ``step_seconds`` after ``flight_start`` up to ``flight_end`` of
    ``bounds``. At each the value nearest in time counts for every column, the later of two at
    equal distance, and of samples that share a time the last by ``tie``. A flight without a
    value in a ``needed`` column has nothing to judge and drops out, like one without a tick.
    """
    keys, step = as_list(keys), step_seconds * MICROS
    entry = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_value")))
        for i, c in enumerate(columns)
    ]
    at = F.struct(*tie) if tie else F.lit(0)
    rows = series.withColumn(US, F.unix_micros(ts)).withColumn(SLICE, slice_id(US, slice_seconds))

    # Per slice: the bounds of its flight and the time of the last sample of each column before it.
    ticks = {"_lo": F.floor(F.unix_micros("flight_start") / step) + 1, "_hi": F.floor(F.unix_micros("flight_end") / step)}
    spread = bounds.withColumns(ticks).filter("_lo <= _hi").select(
        *keys, "_lo", "_hi", F.unix_micros("flight_start").alias("_from"), F.unix_micros("flight_end").alias("_to")
    )
    ends = rows.groupBy(*keys, SLICE).agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(US))).alias(f"_end{i}") for i, c in enumerate(columns)])
    entering = ends.select(
        *keys, SLICE, F.array(*[F.last(f"_end{i}", ignorenulls=True).over(earlier(keys)) for i in range(len(columns))]).alias("_entering")
    )
    entering = entering.join(spread, keys).filter(
        F.col(SLICE).between(slice_id("_from", slice_seconds), slice_id("_to", slice_seconds))
    ).drop("_from", "_to")

    # All steps on samples go by slice, whatever the column: they are shuffled once.
    samples = rows.select(*keys, SLICE, US, at.alias("_tie"), F.inline(F.array_compact(F.array(*entry)))).repartition(*keys, SLICE)
    one = [*keys, "_col"]
    hidden = F.lead(US).over(within(one, ["_tie"])) == F.col(US)  # by a later one of the same time
    samples = samples.withColumn("_hidden", hidden).filter("_hidden IS NOT TRUE").drop("_hidden", "_tie")
    samples = samples.withColumn("_prev", F.lag(US).over(within(one)))
    placed = samples.join(entering, [*keys, SLICE])
    from_ = _up(F.coalesce("_prev", F.get("_entering", F.col("_col"))) + F.col(US), 2 * step)
    placed = placed.withColumn("_tick", F.greatest(F.coalesce(from_, "_lo"), "_lo")).filter("_tick <= _hi")
    placed = placed.select(*keys, slice_id(F.col("_tick") * step, slice_seconds).alias(SLICE), "_hi", "_tick", "_col", US, "_value")
    changes = placed.repartition(*keys, SLICE).groupBy(*keys, SLICE, "_hi", "_tick").agg(
        *[F.max_by("_value", F.when(F.col("_col") == i, F.col(US))).alias(c) for i, c in enumerate(columns)]
    )
    changes = changes.withColumn(US, F.col("_tick") * step)

    # Into every slice come the values before it, and out of it the tick that ends its last stretch.
    offers = changes.groupBy(*keys, SLICE).agg(
        F.min("_tick").alias("_first"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(US))).alias(c) for c in columns]
    )
    borders = offers.select(
        *keys, SLICE, F.lead("_first").over(across(keys)).alias("_next"),
        *[F.last(c, ignorenulls=True).over(earlier(keys)).alias(f"_before_{c}") for c in columns],
    )
    own = changes.withColumns({
        **{c: F.last(c, ignorenulls=True).over(so_far(keys)) for c in columns},
        "_then": F.lead("_tick").over(within(keys)),
    })
    filled = own.join(borders, [*keys, SLICE], "left")
    end = F.coalesce("_then", "_next", F.col("_hi") + 1)
    found = filled.select(
        *keys, F.timestamp_micros(US).alias("ts"), *[F.coalesce(c, f"_before_{c}").alias(c) for c in columns],
        (end - F.col("_tick")).alias(TICKS),
    )
    for c in needed:
        found = found.filter(F.col(c).isNotNull())
    return found
