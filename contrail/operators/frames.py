"""Raw frames: validity, duplicate merging and decoding into typed rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail import schema
from contrail.functions import modes
from contrail.functions.fence import computed
from contrail.operators.slices import (
    MICROS,
    SLICE,
    US,
    across,
    as_list,
    at_least,
    sliced,
)

# Slices folded per block when a chain of repeats runs through many slices.
BLOCK = 256


def with_fields(frames: DataFrame) -> DataFrame:
    """Add df, crc and the icao address to frames; ill-formed hex gives NULLs."""
    long_frame = F.length("hex") == 28
    d = frames.withColumn("hex", F.upper(F.trim("hex")))
    d = d.withColumn("_ok", modes.well_formed(F.col("hex")))
    d = computed(d, {
        "_hi": F.when(F.col("_ok"), modes.hex_long(F.col("hex"), 1, 14)),
        "_lo": F.when(F.col("_ok") & long_frame, modes.hex_long(F.col("hex"), 15, 14)),
    })
    d = computed(d, {
        "df": F.least(modes.bits(F.col("_hi"), 0, 5), F.lit(24)).cast("int"),
        "crc": F.when(long_frame, modes.crc(F.col("_hi"), F.col("_lo"))).otherwise(
            modes.crc(F.col("_hi"), None)
        ),
    })
    # Addressed replies hide the address in the parity: it is what remains of the CRC.
    from_parity = F.lpad(F.hex(F.col("crc").cast("bigint")), 6, "0")
    icao = F.when(F.col("df").isin(11, 17, 18), F.substring("hex", 3, 6)).when(
        F.col("df").isin(0, 4, 5, 16, 20, 21), from_parity
    )
    return d.withColumn("icao", icao).drop("_ok", "_hi", "_lo")


def valid_frames(frames: DataFrame) -> DataFrame:
    """Frames a receiver accepts: intact DF17, long DF20/21, short DF4/5/11."""
    d = with_fields(frames)
    long_frame, short_frame = F.length("hex") == 28, F.length("hex") == 14
    ok = (
        ((F.col("df") == 17) & long_frame & (F.col("crc") == 0))
        | (F.col("df").isin(20, 21) & long_frame)
        | (F.col("df").isin(4, 5, 11) & short_frame)
    )
    return d.filter(ok)


def adsb_only(frames: DataFrame) -> DataFrame:
    """Extended squitters (DF 17 and 18)."""
    d = frames if "df" in frames.columns else with_fields(frames)
    return d.filter(F.col("df").isin(17, 18))


def valid_icao(df: DataFrame, icao: str = "icao") -> DataFrame:
    return df.filter((F.length(icao) == 6) & (F.col(icao) != "000000"))


def type_category(df_: Column, tc: Column) -> Column:
    """Message category of a downlink format and type code; NULL for those not used."""
    return (
        F.when(~df_.isin(17, 18), 0)
        .when(tc.between(1, 4), 1)
        .when(tc.between(5, 8), 2)
        .when(tc.between(9, 18), 3)
        .when(tc.between(20, 22), 4)
        .when(tc == 19, 5)
    )


def decode_messages(
    frames: DataFrame,
    home_lat: float = schema.HOME[0],
    home_lon: float = schema.HOME[1],
    keep_partial: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Frames to typed messages; a narrow projection without any shuffle.

    A message with a missing field is dropped whole; ``keep_partial`` keeps the fields it has.
    Frames of other downlink formats become category 0: a sign of life without data.
    """
    d = frames if "df" in frames.columns else with_fields(frames)
    me = F.col("_me")
    squitter = F.col("df").isin(17, 18) & (F.length("hex") == 28)
    d = computed(d, {"_me": F.when(squitter, modes.hex_long(F.col("hex"), 9, 14))})
    d = d.withColumn("_tc", modes.bits(me, 0, 5).cast("int"))
    d = d.withColumn("type_cat", type_category(F.col("df"), F.col("_tc")))
    d = valid_icao(d).filter(F.col("type_cat").isNotNull())

    cat = F.col("type_cat")
    ident, surface, baro, gnss, velocity = (cat == i for i in range(1, 6))
    airborne = baro | gnss
    d = computed(d, {
        "latitude": F.when(airborne, modes.cpr_latitude(me, home_lat, 360.0)).when(
            surface, modes.cpr_latitude(me, home_lat, 90.0)
        )
    })
    air_speed, air_dir, climb = modes.airborne_velocity(me)
    ground_speed, ground_dir = modes.surface_velocity(me)
    lat = F.col("latitude")
    knots = F.when(velocity, air_speed).when(surface, ground_speed)
    d = computed(d, {
        "callsign": F.when(ident, modes.callsign(me)),
        "cat_tc": F.when(ident, F.col("_tc")),
        "cat_ca": F.when(ident, modes.bits(me, 5, 3).cast("int")),
        "longitude": F.when(airborne, modes.cpr_longitude(me, lat, home_lon, 360.0)).when(
            surface, modes.cpr_longitude(me, lat, home_lon, 90.0)
        ),
        "altitude": F.when(baro, modes.altitude_feet(me) * modes.FOOT_M).when(
            gnss, modes.gnss_altitude_m(me)
        ),
        "horizontal_speed": knots * modes.KNOT_KMH,
        "direction": F.when(velocity, air_dir).when(surface, ground_dir),
        "vertical_speed": F.when(velocity, climb * modes.FEET_PER_MINUTE_MS),
    })
    if not keep_partial:
        whole = (
            F.when(airborne, F.col("altitude").isNotNull())
            .when(
                surface,
                F.col("horizontal_speed").isNotNull() & F.col("direction").isNotNull(),
            )
            .when(
                velocity,
                F.col("horizontal_speed").isNotNull()
                & F.col("direction").isNotNull()
                & F.col("vertical_speed").isNotNull(),
            )
            .otherwise(True)
        )
        d = d.filter(whole)
    return d.select(*[f.name for f in schema.MESSAGES], *keep)


def _exits(times: np.ndarray, limit: int, hop: int) -> list[tuple[int, int]]:
    """Last kept time of a slice for every way of entering it, as (first kept, last kept).

    Only times up to ``limit`` and the first one after it can be kept first. Neighbours with
    the same outcome are merged, keeping the largest first time.
    """
    n = len(times)
    after = np.searchsorted(times, times + hop, side="right")
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    heads = min(int(np.searchsorted(times, limit, side="right")) + 1, n)
    outcome = times[last[:heads]]
    ends = np.append(np.flatnonzero(np.diff(outcome)), heads - 1)
    return [(int(times[i]), int(outcome[i])) for i in ends]


_ENTRY = "head bigint, exit bigint"


def dedup_within(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    seconds: float = schema.MERGE_SECONDS,
    tie: Sequence[str] = (),
    slice_seconds: float = schema.SLICE_SECONDS,
) -> DataFrame:
    """Drop repeats of a key within ``seconds`` of the last row that was kept.

    A row is a repeat when it is at most ``seconds`` after the kept one; the first row after
    that is kept and counts next. Exact copies (equal time) are merged map-side first, so a
    large group of copies never travels. What a slice keeps depends on the last time kept
    before it. That is known without looking back when the silence before the slice is long
    enough; where it is not, each slice is summarised by what it hands on for every possible
    start, and the summaries are chained, in blocks, to find the real one. Slices are never
    shorter than the interval: a shorter one would hand on something else for each of its rows.
    """
    keys, slice_seconds = as_list(keys), at_least(slice_seconds, seconds)
    hop = round(seconds * MICROS)
    rest = [c for c in df.columns if c not in keys]
    rows = sliced(df, ts, slice_seconds)
    by_time = [*keys, SLICE, US]
    whole = F.struct(*rest)
    pick = F.min_by(whole, F.struct(*tie)) if tie else F.min(whole)
    unique = rows.groupBy(*by_time).agg(pick.alias("_row"))

    slices = (
        rows.select(*by_time)
        .distinct()
        .groupBy(*keys, SLICE)
        .agg(F.sort_array(F.collect_list(US)).alias("_times"))
    )
    entering = _entering_times(slices, keys, hop)

    def keep(acc: Column, t: Column) -> Column:
        new = acc["last"].isNull() | (t > acc["last"] + hop)
        return F.when(
            new, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))
        ).otherwise(acc)

    start = F.struct(
        F.col("_entering").alias("last"), F.array().cast("array<bigint>").alias("kept")
    )
    kept = (
        slices.join(entering, [*keys, SLICE], "left")
        .withColumn("_kept", F.aggregate("_times", start, keep, lambda acc: acc["kept"]))
        .select(*keys, SLICE, F.explode("_kept").alias(US))
    )
    return (
        unique.join(kept, by_time, "left_semi").select(*keys, "_row.*").select(*df.columns)
    )


def _entering_times(slices: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """Last time kept before each slice that a chain of repeats runs into."""
    order = across(keys)
    gap = F.element_at("_times", 1) - F.lag(F.element_at("_times", -1)).over(order)
    chained = slices.withColumns({
        "_limit": F.lag(F.element_at("_times", -1)).over(order) + hop,
        "_linked": F.coalesce(gap <= hop, F.lit(False)),
    })
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.withColumns({
        "_chain": F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(run),
        "_leads": F.coalesce(F.lead("_linked").over(order), F.lit(False)),
    }).filter("_linked OR _leads")

    @F.pandas_udf(f"array<struct<{_ENTRY}>>")
    def exits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for times, limits in batches:
            yield pd.Series([
                [{"head": h, "exit": x} for h, x in _exits(np.asarray(t), int(m), hop)]
                for t, m in zip(times, limits)
            ])

    # The first slice of a chain is entered at its first row: no limit reaches it.
    limit = F.when(F.col("_linked"), F.col("_limit")).otherwise(F.element_at("_times", 1) - 1)
    nth = Window.partitionBy(*keys, "_chain").orderBy(SLICE)
    steps = chained.select(
        *keys, SLICE, "_chain", limit.alias("_limit"), exits("_times", limit).alias("_exits")
    ).withColumn("_block", F.floor((F.row_number().over(nth) - 1) / BLOCK))

    def follow(last: Column, entries: Column) -> Column:
        """Last time kept after a slice entered with ``last``."""
        hit = F.filter(entries, lambda e: last.isNull() | (e["head"] > last + hop))
        return F.coalesce(F.try_element_at(hit, F.lit(1))["exit"], last)

    item = F.struct(SLICE, "_limit", "_exits")
    blocks = steps.groupBy(*keys, "_chain", "_block").agg(
        F.sort_array(F.collect_list(item)).alias("_steps")
    )
    # A block as a whole maps the ways into it to what it hands on. It can be entered at any
    # time up to the limit of its first slice or at the first one after that.
    ways = F.flatten(
        F.transform(
            "_steps",
            lambda s, i: F.transform(
                s["_exits"],
                lambda e: F.struct(e["head"].alias("head"), e["exit"].alias("exit"), i.alias("i")),
            ),
        )
    )
    reach = F.element_at("_steps", 1)["_limit"]
    blocks = blocks.withColumn("_ways", ways).withColumn(
        "_ways",
        F.concat(
            F.filter("_ways", lambda e: e["head"] <= reach),
            F.slice(F.filter("_ways", lambda e: e["head"] > reach), 1, 1),
        ),
    )
    blocks = blocks.withColumn(
        "_exits",
        F.transform(
            "_ways",
            lambda e: F.struct(
                e["head"].alias("head"),
                F.aggregate(
                    F.slice("_steps", e["i"] + 2, F.size("_steps")),
                    e["exit"],
                    lambda acc, s: follow(acc, s["_exits"]),
                ).alias("exit"),
            ),
        ),
    ).drop("_ways")

    def fold(entries: str, start: Column, label: str) -> Column:
        """Entering time of every item, in order."""
        init = F.struct(
            start.alias("last"),
            F.array().cast("array<struct<at:bigint,entering:bigint>>").alias("seen"),
        )
        return F.aggregate(
            entries,
            init,
            lambda acc, s: F.struct(
                follow(acc["last"], s["_exits"]).alias("last"),
                F.concat(
                    acc["seen"],
                    F.array(F.struct(s[label].alias("at"), acc["last"].alias("entering"))),
                ).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    # A block passed through without a kept row hands on what it was given.
    block_item = F.struct("_block", "_exits")
    into_block = (
        blocks.groupBy(*keys, "_chain")
        .agg(F.sort_array(F.collect_list(block_item)).alias("_blocks"))
        .select(
            *keys, "_chain",
            F.inline(fold("_blocks", F.lit(None).cast("bigint"), "_block")),
        )
        .withColumnsRenamed({"at": "_block", "entering": "_start"})
    )
    return (
        blocks.drop("_exits")
        .join(into_block, [*keys, "_chain", "_block"])
        .select(*keys, F.inline(fold("_steps", F.col("_start"), SLICE)))
        .withColumnsRenamed({"at": SLICE, "entering": "_entering"})
    )
