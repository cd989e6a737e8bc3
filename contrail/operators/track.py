"""Per-aircraft track operators: ordered series, flights, motion, as-of lookups, counts.

All ordered operators run on time slices (see slices.py). ``keys`` names the aircraft (and
the flight, where there is one), ``ts`` the time and ``tie`` the columns that order rows of
equal time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail import schema
from contrail.functions import geo
from contrail.functions.fence import computed
from contrail.operators.slices import (
    MICROS,
    SLICE,
    US,
    Width,
    across,
    as_list,
    earlier,
    position,
    slice_id,
    sliced,
    so_far,
    with_previous,
    within,
    within_sql,
)

Keys = str | Sequence[str]


def suppress_repeats(
    df: DataFrame,
    keys: Keys,
    ts: str,
    value: str,
    tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Keep a value only where it differs from the one before it."""
    keys = as_list(keys)
    rows = sliced(df.filter(F.col(value).isNotNull()), ts, slice_seconds)
    seen = with_previous(rows, keys, [value], tie, "_seen")
    return seen.filter(
        F.col("_seen").isNull() | (F.col(value) != F.col("_seen")[value])
    ).drop("_seen", US, SLICE)


def changed_pairs(
    df: DataFrame,
    keys: Keys,
    ts: str,
    pair: Sequence[str],
    tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Drop a row whose (value, time) pair equals that of the latest row in every part."""
    keys = as_list(keys)
    seen = with_previous(sliced(df, ts, slice_seconds), keys, pair, tie, "_seen")
    same = F.col("_seen").isNotNull()
    for c in pair:
        same = same & F.col(c).eqNullSafe(F.col("_seen")[c])
    return seen.filter(~same).drop("_seen", US, SLICE)


def flights(
    df: DataFrame,
    keys: Keys,
    ts: str,
    gap_seconds: float = schema.REMEMBER_SECONDS,
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Add ``flight_start``. A silence longer than ``gap_seconds`` starts a new flight."""
    keys = as_list(keys)
    gap = round(gap_seconds * MICROS)
    rows = sliced(df, ts, slice_seconds)
    starts = F.when(F.col(US) - F.lag(US).over(within(keys)) > gap, F.col(US))

    ends = (
        rows.select(*keys, SLICE, US)
        .withColumn("_start", starts)
        .groupBy(*keys, SLICE)
        .agg(
            F.min(US).alias("_first"),
            F.max(US).alias("_last"),
            F.max("_start").alias("_start"),
        )
    )
    silence = F.col("_first") - F.lag("_last").over(across(keys))
    ends = ends.withColumn(
        "_opens", F.when(silence.isNull() | (silence > gap), F.col("_first"))
    )
    running = F.last(F.coalesce("_start", "_opens"), ignorenulls=True).over(earlier(keys))
    entering = ends.select(*keys, SLICE, F.coalesce("_opens", running).alias("_entering"))

    return (
        rows.withColumn("_start", starts)
        .withColumn("_start", F.max("_start").over(so_far(keys)))
        .join(entering, [*keys, SLICE], "left")
        .withColumn("flight_start", F.timestamp_micros(F.coalesce("_start", "_entering")))
        .drop("_start", "_entering", US, SLICE)
    )


def flight_bounds(
    df: DataFrame, keys: Keys, ts: str, gap_seconds: float = schema.REMEMBER_SECONDS
) -> DataFrame:
    """One row per flight: first and last time and number of rows.

    ``session_window`` merges map-side before the shuffle when
    ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` is set, and works on streams.
    A row exactly ``gap_seconds`` after the last one stays in the flight, hence the extra
    microsecond.
    """
    keys = as_list(keys)
    gap = f"{round(gap_seconds * MICROS) + 1} microseconds"
    return (
        df.groupBy(*keys, F.session_window(ts, gap).alias("_session"))
        .agg(
            F.min(ts).alias("flight_start"),
            F.max(ts).alias("flight_end"),
            F.count(F.lit(1)).alias("packets"),
        )
        .drop("_session")
    )


def latest(
    df: DataFrame, keys: Keys, ts: str, cols: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """Last non-missing value of each column per key."""
    at = F.struct(ts, *tie)
    return df.groupBy(*as_list(keys)).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols]
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
    times: bool = False,
) -> DataFrame:
    """For every left row and column, the right value nearest in time on either side.

    Each column is its own series: nulls are not part of it. Equal distances go to the later
    value, and of right rows that share a time the last by ``tie`` counts. With ``times`` the
    time of the chosen value is added as ``<col>_ts``.
    """
    keys = as_list(keys)
    own = [c for c in left.columns if c not in keys]
    lefts = left.select(*keys, F.struct(*own).alias("_row"), F.unix_micros(ts).alias(US))
    rights = right.select(
        *keys,
        F.unix_micros(ts).alias(US),
        F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"),
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct(F.unix_micros(ts).alias("us"), F.col(c).alias("value")),
            ).alias(f"_v{i}")
            for i, c in enumerate(cols)
        ],
    )
    rows = (
        rights.withColumn("_side", F.lit(0))
        .unionByName(lefts.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        .withColumn(SLICE, slice_id(US, slice_seconds))
    )

    # What each slice offers its neighbours: per column its first and last value.
    at = F.struct(US, "_tie")
    offers = []
    for i in range(len(cols)):
        present = F.col(f"_v{i}").isNotNull()
        offers += [
            F.max_by(f"_v{i}", F.when(present, at)).alias(f"_last{i}"),
            F.min(F.when(present, F.col(US))).alias(f"_us{i}"),
        ]
    # The first value of a slice is the last by tie among those at its earliest time.
    firsts = rights.withColumn(SLICE, slice_id(US, slice_seconds)).groupBy(*keys, SLICE).agg(
        *[
            F.max_by(
                f"_v{i}",
                F.when(F.col(f"_v{i}").isNotNull(), F.struct(-F.col(US), F.col("_tie"))),
            ).alias(f"_first{i}")
            for i in range(len(cols))
        ],
        *[o for k, o in enumerate(offers) if k % 2 == 0],
    )
    borders = (
        lefts.select(*keys, slice_id(US, slice_seconds).alias(SLICE))
        .distinct()
        .unionByName(firsts, allowMissingColumns=True)
        .groupBy(*keys, SLICE)
        .agg(
            *[
                F.first(f"_{end}{i}", ignorenulls=True).alias(f"_{end}{i}")
                for i in range(len(cols))
                for end in ("first", "last")
            ]
        )
    )
    later = Window.partitionBy(*keys).orderBy(F.desc(SLICE)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    entering = borders.select(
        *keys,
        SLICE,
        *[
            F.last(f"_last{i}", ignorenulls=True).over(earlier(keys)).alias(f"_before{i}")
            for i in range(len(cols))
        ],
        *[
            F.last(f"_first{i}", ignorenulls=True).over(later).alias(f"_after{i}")
            for i in range(len(cols))
        ],
    )

    order = ["_side", "_tie"]
    over = within_sql(keys, order)
    # A value followed by another one at the same time is hidden by it.
    hidden = rows.withColumns({
        f"_v{i}": F.expr(
            f"CASE WHEN (lead(_v{i}) IGNORE NULLS OVER {over}).us <=> {US} THEN NULL ELSE _v{i} END"
        )
        for i in range(len(cols))
    })
    found = hidden.withColumns({
        **{
            f"_p{i}": F.last(f"_v{i}", ignorenulls=True).over(so_far(keys, order))
            for i in range(len(cols))
        },
        **{
            f"_n{i}": F.expr(f"lead(_v{i}) IGNORE NULLS OVER {over}")
            for i in range(len(cols))
        },
    })
    joined = found.filter("_side = 1").join(entering, [*keys, SLICE], "left")
    picks = []
    for i, c in enumerate(cols):
        before = F.coalesce(f"_p{i}", f"_before{i}")
        after = F.coalesce(f"_n{i}", f"_after{i}")
        take_after = before["us"].isNull() | (
            after["us"] - F.col(US) <= F.col(US) - before["us"]
        )
        pick = F.when(after["us"].isNotNull() & take_after, after).otherwise(before)
        picks.append(pick["value"].alias(c))
        if times:
            picks.append(F.timestamp_micros(pick["us"]).alias(f"{c}_ts"))
    return joined.select(*keys, "_row.*", *picks)


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(F.col(US).alias("us"), lat.alias("lat"), lon.alias("lon"))


def _moved(a: Column, b: Column) -> Column:
    return (a["lat"] != b["lat"]) | (a["lon"] != b["lon"])


def motion(
    messages: DataFrame,
    back_n: int = schema.BACK_N,
    fresh_seconds: float | None = None,
    keys: Keys = "icao",
    ts: str = "ts",
    tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
    at: str = "updates",
) -> DataFrame:
    """Track state after every message: position, speed, heading and the last of each datum.

    Speed and heading are measured over ``back_n`` distinct positions (or from the first one
    while there are fewer). A received speed or heading younger than ``fresh_seconds``
    relative to the position is used instead. Rows appear once an aircraft has two positions:
    after every message (``at="updates"``) or only where the position changed
    (``at="positions"``).
    """
    if back_n < 2:
        raise ValueError("back_n must be at least 2")
    if at not in ("updates", "positions"):
        raise ValueError("at must be 'updates' or 'positions'")
    keys, tie = as_list(keys), list(tie)
    fresh = round((back_n if fresh_seconds is None else fresh_seconds) * MICROS)
    carried = [
        c
        for c in ("callsign", "altitude", "vertical_speed", "horizontal_speed", "direction")
        if c in messages.columns
    ]
    rows = sliced(messages.select(*keys, ts, *tie, "latitude", "longitude", *carried), ts, slice_seconds)
    has_fix = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = rows.withColumn("_fix", F.when(has_fix, _point(F.col("latitude"), F.col("longitude"))))
    for c in carried:
        rows = rows.withColumn(
            f"_{c}",
            F.when(F.col(c).isNotNull(), F.struct(F.col(US).alias("us"), F.col(c).alias("value"))),
        )
    rows = rows.drop("latitude", "longitude", *carried)

    def last_of(name: str) -> Column:
        here = F.col(name).isNotNull()
        return F.max_by(name, F.when(here, position(tie))).alias(name)

    # Per slice: the last fix and the last of each datum.
    states = ["_fix", *[f"_{c}" for c in carried]]
    ends = rows.groupBy(*keys, SLICE).agg(*[last_of(c) for c in states])
    entering = ends.select(
        *keys,
        SLICE,
        *[
            F.last(c, ignorenulls=True).over(earlier(keys)).alias(f"{c}_in")
            for c in states
        ],
    )

    # Per slice: its last back_n + 1 distinct fixes; one more because the first fix of the
    # slice may turn out to repeat the one before the slice.
    over = within_sql(keys, tie)
    near = rows.withColumn("_near", F.expr(f"lag(_fix) IGNORE NULLS OVER {over}"))
    newest_first = Window.partitionBy(*keys, SLICE).orderBy(
        F.desc(US), *[F.desc(c) for c in tie]
    )
    fresh_fix = F.col("_near").isNull() | _moved(F.col("_near"), F.col("_fix"))
    tails = (
        near.filter(F.col("_fix").isNotNull() & fresh_fix)
        .select(*keys, SLICE, US, *tie, "_fix", F.col("_near").isNull().alias("_head"))
        .withColumn("_nth", F.row_number().over(newest_first))
        .filter(F.col("_nth") <= back_n + 1)
        .join(entering.select(*keys, SLICE, "_fix_in"), [*keys, SLICE])
        .filter(
            ~F.col("_head")
            | F.col("_fix_in").isNull()
            | _moved(F.col("_fix_in"), F.col("_fix"))
        )
    )
    by_key = Window.partitionBy(*keys).orderBy(US, *tie)
    recent = (
        tails.withColumn(
            "_recent", F.collect_list("_fix").over(by_key.rowsBetween(-(back_n - 1), 0))
        )
        .groupBy(*keys, SLICE)
        .agg(
            F.max_by("_recent", position(tie)).alias("_recent"),
            F.min_by("_fix", position(tie)).alias("_first"),
        )
    )
    entering = (
        entering.join(recent, [*keys, SLICE], "left")
        .withColumn("_tail", F.last("_recent", ignorenulls=True).over(earlier(keys)))
        .withColumn("_oldest", F.first("_first", ignorenulls=True).over(earlier(keys)))
        .drop("_recent", "_first")
    )

    # Every row: current fix, the fix back_n - 1 distinct fixes earlier, datums so far.
    before = F.coalesce("_near", "_fix_in")
    is_new = F.col("_fix").isNotNull() & (before.isNull() | _moved(before, F.col("_fix")))
    run = so_far(keys, tie)
    d = near.join(entering, [*keys, SLICE], "left").withColumn("_new", F.when(is_new, F.col("_fix")))
    d = d.withColumns({
        "_seen": F.count("_new").over(run),
        "_cur": F.last("_new", ignorenulls=True).over(run),
        "_opening": F.first("_new", ignorenulls=True).over(run),
        "_back": F.expr(
            f"CASE WHEN _new IS NOT NULL THEN lag(_new, {back_n - 1}) IGNORE NULLS OVER {over} "
            f"ELSE lag(_new, {back_n}) IGNORE NULLS OVER {over} END"
        ),
        **{f"_{c}": F.last(f"_{c}", ignorenulls=True).over(run) for c in carried},
    })
    for c in carried:
        d = d.withColumn(f"_{c}", F.coalesce(f"_{c}", f"_{c}_in"))
    held = F.coalesce(F.size("_tail"), F.lit(0))
    from_tail = F.when(
        held >= back_n - F.col("_seen"),
        F.try_element_at("_tail", (F.col("_seen") - back_n).cast("int")),
    )
    d = computed(d, {
        "_cur": F.coalesce("_cur", F.try_element_at("_tail", F.lit(-1))),
        "_back": F.when(F.col("_seen") >= back_n, F.col("_back")).otherwise(
            F.coalesce(from_tail, "_oldest", "_opening")
        ),
        "_fixes": F.col("_seen") + held,
    }).filter("_fixes >= 2")
    if at == "positions":
        d = d.filter(F.col("_new").isNotNull())

    return finish_motion(d, carried, fresh, [*keys, ts, *tie])


def finish_motion(d: DataFrame, carried: Sequence[str], fresh: int, keep: Sequence[str]) -> DataFrame:
    """Speed and heading of rows that hold the current fix ``_cur`` and the earlier ``_back``.

    ``_<datum>`` holds the last value of each of ``carried`` as struct(us, value).
    """
    here = F.col("_cur")
    back = F.col("_back")
    seconds = (here["us"] - back["us"]) / F.lit(float(MICROS))
    d = geo.with_distance(d, back["lat"], back["lon"], here["lat"], here["lon"], "_km")
    measured = geo.speed_kmh(F.col("_km"), seconds)
    course = geo.bearing(back["lat"], back["lon"], here["lat"], here["lon"])

    def received(name: str) -> tuple[Column, Column]:
        if name not in carried:
            return F.lit(False), F.lit(None)
        got = F.col(f"_{name}")
        return F.coalesce(here["us"] - got["us"] < fresh, F.lit(False)), got

    speed_ok, speed = received("horizontal_speed")
    head_ok, head = received("direction")
    value = lambda got: got["value"] if got is not None else None
    reported = "horizontal_speed" in carried
    out = [
        F.timestamp_micros(here["us"]).alias("position_ts"),
        here["lat"].alias("latitude"),
        here["lon"].alias("longitude"),
        *[
            F.col(f"_{c}")["value"].alias(c)
            for c in carried
            if c in ("callsign", "altitude", "vertical_speed")
        ],
        (F.when(speed_ok, value(speed)).otherwise(measured) if reported else measured).alias("speed"),
        F.timestamp_micros(
            F.when(speed_ok, speed["us"]).otherwise(here["us"]) if reported else here["us"]
        ).alias("speed_ts"),
        (
            F.when(head_ok, value(head)).otherwise(course) if "direction" in carried else course
        ).alias("heading"),
    ]
    return d.select(*keep, *out)


def plane_stats(messages: DataFrame, keys: Keys = "icao", ts: str = "ts") -> DataFrame:
    """Packets, first and last time per aircraft (or flight)."""
    return messages.groupBy(*as_list(keys)).agg(
        F.count(F.lit(1)).alias("packets"),
        F.min(ts).alias("first_packet"),
        F.max(ts).alias("last_update"),
    )


def packet_types(
    messages: DataFrame, keys: Keys = "icao", kind: str = "type_cat"
) -> DataFrame:
    """Histogram map category -> count. The map is as small as the set of categories."""
    keys = as_list(keys)
    return (
        messages.groupBy(*keys, kind)
        .count()
        .groupBy(*keys)
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "count")))).alias(
                "packet_type"
            )
        )
    )


def plane_info(
    messages: DataFrame, keys: Keys = "icao", ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """Callsign and emitter category; the last non-missing value wins."""
    category = F.when(F.col("cat_tc").isNotNull(), F.struct("cat_tc", "cat_ca"))
    return latest(
        messages.withColumn("plane_category", category),
        keys, ts, ["callsign", "plane_category"], tie,
    )


def tracked(messages: DataFrame, key: str = "icao", ts: str = "ts") -> DataFrame:
    """Number of aircraft and the newest time, in one row."""
    return messages.agg(
        F.count_distinct(key).alias("planes"), F.max(ts).alias("last_update")
    )


def long_series(
    df: DataFrame, keys: Keys, ts: str, datums: Sequence[str], category: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Wide datum columns to rows (keys, category, type, ts, value); nulls are absent."""
    keys = as_list(keys)
    pairs = F.array(*[
        F.struct(F.lit(d).alias("type"), F.col(d).cast("double").alias("value")) for d in datums
    ])
    return df.select(*keys, ts, *tie, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull()))).select(
        *keys, F.lit(category).alias("category"), "type", ts, *tie, "value"
    )


def received_series(
    messages: DataFrame, keys: Keys = "icao", ts: str = "ts", tie: Sequence[str] = (),
    datums: Sequence[str] = schema.RECEIVED, slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Received datums as run-length suppressed series."""
    keys = as_list(keys)
    rows = long_series(messages, keys, ts, datums, "received_data", tie)
    return suppress_repeats(rows, [*keys, "type"], ts, "value", tie, slice_seconds)


def calculated_series(
    states: DataFrame, keys: Keys = "icao", ts: str = "ts", tie: Sequence[str] = (),
    slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Calculated speed and direction, each appended only when its (value, time) changed.

    Both carry the time of the speed they came with, and are appended in message order.
    """
    keys = as_list(keys)
    rows = states.select(
        *keys, ts, *tie, "speed_ts",
        F.col("speed").alias("horizontal_speed"), F.col("heading").alias("direction"),
    )
    rows = long_series(rows, keys, ts, schema.CALCULATED, "calculated_data", [*tie, "speed_ts"])
    kept = changed_pairs(rows, [*keys, "type"], ts, ["value", "speed_ts"], tie, slice_seconds)
    return kept.withColumn(ts, F.col("speed_ts")).drop("speed_ts")


def series_chunks(
    series: DataFrame, keys: Keys, ts: str = "ts", value: str = "value",
    tie: Sequence[str] = (), slice_seconds: Width = schema.SLICE_SECONDS,
) -> DataFrame:
    """Series as arrays of (time, value) in time order, one array per slice.

    A whole series can be any length, so it is never put in one row: ``chunk`` numbers its
    pieces and reading them in that order gives the series.
    """
    keys = as_list(keys)
    rows = sliced(series, ts, slice_seconds)
    item = F.struct(
        F.col(US).alias("us"), *tie, F.col(value).alias("value")
    )
    return (
        rows.groupBy(*keys, F.col(SLICE).alias("chunk"))
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .withColumn(
            "data",
            F.transform(
                "_items",
                lambda x: F.struct(
                    (x["us"] / F.lit(float(MICROS))).alias("time"), x["value"].alias("value")
                ),
            ),
        )
        .drop("_items")
    )


def top_planes(stats: DataFrame, k: int = schema.TOP_PLANES, key: str = "icao") -> DataFrame:
    """The k busiest aircraft; k = 0 gives none and k = -1 all of them, in order."""
    order = [F.desc("packets"), F.asc("first_packet"), F.asc(key)]
    if k < -1:
        raise ValueError("k must be -1, 0 or positive")
    return stats.orderBy(*order) if k == -1 else stats.orderBy(*order).limit(k)


def status_lines(
    stats: DataFrame, k: int = schema.TOP_PLANES, advanced: bool = True, key: str = "icao"
) -> DataFrame:
    """Text per top aircraft, busiest first.

    The plain form reads ``key (packets)``; the advanced form adds the callsign and the
    packet type histogram (columns ``callsign`` and ``packet_type``).
    """
    top = top_planes(stats, k, key)
    if advanced:
        types = F.concat(
            F.lit("{"),
            F.concat_ws(
                ", ",
                F.transform(
                    F.map_entries("packet_type"),
                    lambda e: F.concat_ws(": ", e["key"].cast("string"), e["value"].cast("string")),
                ),
            ),
            F.lit("}"),
        )
        named = F.coalesce(F.length("callsign") > 0, F.lit(False))
        name = F.when(named, F.concat_ws("/", key, "callsign")).otherwise(
            F.concat(F.col(key).cast("string"), F.lit(","))
        )
        text = F.concat(
            name, F.lit(" ("), F.col("packets").cast("string"), F.lit(", "), types, F.lit(")")
        )
    else:
        text = F.concat(
            F.col(key).cast("string"), F.lit(" ("), F.col("packets").cast("string"), F.lit(")")
        )
    return top.select(key, "packets", "first_packet", text.alias("line"))


def status_message(lines: DataFrame, k: int, key: str = "icao") -> DataFrame:
    """The k lines of ``status_lines`` (k >= 1) as the one-row message ``Top k: ...``."""
    if k < 1:
        raise ValueError("a one-row message needs k of 1 or more; use status_lines for all")
    item = F.struct(-F.col("packets"), F.col("first_packet"), F.col(key), F.col("line"))
    return (
        lines.agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .filter(F.size("_items") > 0)
        .select(
            F.concat(
                F.lit("Top "), F.size("_items").cast("string"), F.lit(": "),
                F.concat_ws(", ", F.transform("_items", lambda x: x["line"])),
            ).alias("message")
        )
    )
