"""Registered queries: ordered series, flights, motion, as-of lookups, counts, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.catalog.base import (
    EV,
    MSG,
    SIX_HOURS,
    bearing_sql,
    events,
    km_sql,
    messages,
    table,
    us,
    width,
    with_,
)
from contrail.operators import track
from contrail.operators.frames import dedup_within
from contrail.operators.slices import fit_slices
from contrail.sources.frames import union_receivers

GAP_US = SIX_HOURS * 1_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(with_(EV, select="""
    SELECT event_id, user_id, event_type FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before
      FROM ev) WHERE before IS NULL OR event_type <> before"""))
def suppress_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kept = track.suppress_repeats(e, "user_id", "ts", "event_type", ["event_id"], width(spark, sf_dir))
    return kept.select("event_id", "user_id", "event_type")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples of the few values of ``l_linestatus``: each key holds a large part of all rows."""
    shipped = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_orderkey", "l_linenumber", "l_quantity", F.timestamp_micros(shipped).alias("ts")
    )


_LINES = "(PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber)"


@query(f"""SELECT l_linestatus, l_orderkey, l_linenumber, l_quantity FROM (
    SELECT *, lag(l_quantity) OVER {_LINES} AS before FROM lineitem) WHERE before IS NULL OR before <> l_quantity""")
def repeats_of_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length suppression where two keys have half of all rows each, with slices of their own width."""
    rows = lines(spark, sf_dir)
    tie = ["l_orderkey", "l_linenumber"]
    plan = fit_slices(rows, "l_linestatus", "ts", target_rows=20_000)
    kept = track.suppress_repeats(rows, "l_linestatus", "ts", "l_quantity", tie, plan)
    return kept.select("l_linestatus", *tie, "l_quantity")


@query(with_(EV, select="""
    , c AS (SELECT *, CAST(floor(value / 100) AS BIGINT) AS step, us // 86400000000 AS day FROM ev)
    SELECT event_id, user_id, step, day FROM (
      SELECT *, lag(step) OVER w AS ls, lag(day) OVER w AS ld FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    WHERE ls IS NULL OR ls <> step OR ld <> day"""))
def changed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({
        "step": F.floor(F.col("value") / 100),
        "day": F.floor(us("ts") / 86_400_000_000),
    })
    kept = track.changed_pairs(e, "user_id", "ts", ["step", "day"], ["event_id"], width(spark, sf_dir))
    return kept.select("event_id", "user_id", "step", "day")


FLIGHTS = f"""f AS (
  SELECT *, max(CASE WHEN opens THEN us END) OVER (
      PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS start_us
  FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {GAP_US},
                           true) AS opens FROM ev))"""


@query(with_(EV, FLIGHTS, select="SELECT event_id, user_id, start_us FROM f"))
def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = track.flights(events(spark, sf_dir), "user_id", "ts", SIX_HOURS, width(spark, sf_dir))
    return f.select("event_id", "user_id", us("flight_start").alias("start_us"))


@query(with_(EV, FLIGHTS, select="""
    SELECT user_id, start_us, max(us) AS end_us, count(*) AS packets FROM f GROUP BY ALL"""))
def flight_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = track.flight_bounds(events(spark, sf_dir), "user_id", "ts", SIX_HOURS)
    return b.select(
        "user_id", us("flight_start").alias("start_us"), us("flight_end").alias("end_us"), "packets"
    )


@query(with_(MSG, select="""
    SELECT icao,
      arg_max(callsign, (us, event_id)) FILTER (WHERE callsign IS NOT NULL) AS callsign,
      arg_max(altitude, (us, event_id)) FILTER (WHERE altitude IS NOT NULL) AS altitude,
      arg_max(horizontal_speed, (us, event_id)) FILTER (WHERE horizontal_speed IS NOT NULL)
        AS horizontal_speed
    FROM m GROUP BY icao"""))
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["callsign", "altitude", "horizontal_speed"]
    return track.latest(messages(spark, sf_dir), "icao", "ts", cols, ["event_id"])


@query(with_(EV, select="""
    , r AS (SELECT user_id, us, arg_max(value, event_id) AS value FROM ev
            WHERE event_type = 'view' GROUP BY user_id, us)
    , l AS (SELECT * FROM ev WHERE event_type = 'purchase')
    , best AS (
      SELECT l.event_id, r.value AS near_value, r.us AS near_us,
        row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.us - l.us), r.us DESC) AS n
      FROM l JOIN r USING (user_id))
    SELECT l.event_id, l.user_id, b.near_value, b.near_us FROM l
    LEFT JOIN (SELECT * FROM best WHERE n = 1) b USING (event_id)"""))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select(
        "user_id", "ts", "event_id", F.col("value").alias("near_value")
    )
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    near = track.asof_nearest(
        bought, views, "user_id", "ts", ["near_value"], ["event_id"], width(spark, sf_dir), times=True
    )
    return near.select("event_id", "user_id", "near_value", us("near_value_ts").alias("near_us"))


MOTION = f"""q AS (
  SELECT *, last_value(CASE WHEN latitude IS NOT NULL THEN {{'a': latitude, 'b': longitude}} END
      IGNORE NULLS) OVER (PARTITION BY icao ORDER BY us, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM m),
n AS (
  SELECT *, latitude IS NOT NULL AND (before IS NULL OR before.a <> latitude OR before.b <> longitude)
    AS isnew FROM q),
c AS (
  SELECT *, count(*) FILTER (WHERE isnew) OVER w AS fixes,
    last_value(altitude IGNORE NULLS) OVER w AS alt,
    last_value(callsign IGNORE NULLS) OVER w AS cs,
    last_value(CASE WHEN horizontal_speed IS NOT NULL THEN {{'us': us, 'v': horizontal_speed}} END
      IGNORE NULLS) OVER w AS hs,
    last_value(CASE WHEN direction IS NOT NULL THEN {{'us': us, 'v': direction}} END
      IGNORE NULLS) OVER w AS dr
  FROM n WINDOW w AS (PARTITION BY icao ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT icao, fixes AS nth, us, latitude, longitude FROM c WHERE isnew),
states AS (
  SELECT c.event_id, c.icao, c.us, c.isnew, h.latitude, h.longitude, c.alt AS altitude,
    c.cs AS callsign, h.us AS position_us,
    CASE WHEN h.us - c.hs.us < {GAP_US} THEN c.hs.v ELSE
      {km_sql('b.latitude', 'b.longitude', 'h.latitude', 'h.longitude')} * 3600
      / ((h.us - b.us) / 1e6) END AS speed,
    CASE WHEN h.us - c.hs.us < {GAP_US} THEN c.hs.us ELSE h.us END AS speed_us,
    CASE WHEN h.us - c.dr.us < {GAP_US} THEN c.dr.v ELSE
      {bearing_sql('b.latitude', 'b.longitude', 'h.latitude', 'h.longitude')} END AS heading
  FROM c JOIN k h ON h.icao = c.icao AND h.nth = c.fixes
  JOIN k b ON b.icao = c.icao AND b.nth = greatest(c.fixes - 9, 1)
  WHERE c.fixes >= 2)"""


def states(spark: SparkSession, sf_dir: str, at: str = "updates") -> DataFrame:
    return track.motion(
        messages(spark, sf_dir), 10, SIX_HOURS, "icao", "ts", ["event_id"], width(spark, sf_dir), at
    )


@query(with_(MSG, MOTION, select="""
    SELECT event_id, icao, latitude, longitude, altitude, callsign, position_us,
      round(speed, 3) AS speed, speed_us, round(heading, 3) AS heading FROM states"""))
def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select(
        "event_id", "icao", "latitude", "longitude", "altitude", "callsign",
        us("position_ts").alias("position_us"),
        F.round("speed", 3).alias("speed"), us("speed_ts").alias("speed_us"),
        F.round("heading", 3).alias("heading"),
    )


@query(with_(MSG, MOTION, select="""
    SELECT event_id, icao, round(speed, 3) AS speed, round(heading, 3) AS heading
    FROM states WHERE isnew"""))
def motion_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir, "positions").select(
        "event_id", "icao", F.round("speed", 3).alias("speed"), F.round("heading", 3).alias("heading")
    )


@query(with_(MSG, select="""
    SELECT icao, count(*) AS packets, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY icao"""))
def plane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = track.plane_stats(messages(spark, sf_dir))
    return s.select(
        "icao", "packets", us("first_packet").alias("first_us"), us("last_update").alias("last_us")
    )


@query(with_(MSG, select="SELECT icao, type_cat, count(*) AS n FROM m GROUP BY ALL"))
def packet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track.packet_types(messages(spark, sf_dir))
    return t.select("icao", F.explode("packet_type").alias("type_cat", "n"))


@query(with_(MSG, select="""
    SELECT icao,
      arg_max(callsign, (us, event_id)) FILTER (WHERE callsign IS NOT NULL) AS callsign,
      arg_max(cat_ca, (us, event_id)) FILTER (WHERE cat_tc IS NOT NULL) AS cat_ca
    FROM m GROUP BY icao"""))
def plane_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = track.plane_info(messages(spark, sf_dir), tie=["event_id"])
    return i.select("icao", "callsign", F.col("plane_category.cat_ca").cast("bigint").alias("cat_ca"))


@query(with_(MSG, select="""
    , s AS (SELECT * FROM (
        SELECT icao, us, event_id, 'altitude' AS type, altitude AS value FROM m
        UNION ALL SELECT icao, us, event_id, 'latitude', latitude FROM m
        UNION ALL SELECT icao, us, event_id, 'longitude', longitude FROM m
        UNION ALL SELECT icao, us, event_id, 'vertical_speed', vertical_speed FROM m
        UNION ALL SELECT icao, us, event_id, 'horizontal_speed', horizontal_speed FROM m
        UNION ALL SELECT icao, us, event_id, 'direction', direction FROM m)
      WHERE value IS NOT NULL)
    SELECT icao, type, us, value FROM (
      SELECT *, lag(value) OVER (PARTITION BY icao, type ORDER BY us, event_id) AS before FROM s)
    WHERE before IS NULL OR before <> value"""))
def received_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = track.received_series(
        messages(spark, sf_dir), tie=["event_id"], slice_seconds=width(spark, sf_dir)
    )
    return s.select("icao", "type", us("ts").alias("us"), "value")


@query(with_(MSG, MOTION, select="""
    , s AS (SELECT icao, us, event_id, speed_us, 'horizontal_speed' AS type, speed AS value FROM states
      UNION ALL SELECT icao, us, event_id, speed_us, 'direction', heading FROM states)
    SELECT icao, type, speed_us AS us, round(value, 3) AS value FROM (
      SELECT *, lag(value) OVER w AS lv, lag(speed_us) OVER w AS lu FROM s
      WINDOW w AS (PARTITION BY icao, type ORDER BY us, event_id))
    WHERE lv IS NULL OR lv <> value OR lu <> speed_us"""))
def calculated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = track.calculated_series(
        states(spark, sf_dir), tie=["event_id"], slice_seconds=width(spark, sf_dir)
    )
    return s.select("icao", "type", us("ts").alias("us"), F.round("value", 3).alias("value"))


@query(with_(EV, select="""
    SELECT user_id, event_type, count(*) AS n, true AS in_order, min(us) AS first_us,
      max(us) AS last_us, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM ev GROUP BY ALL"""))
def series_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every series, checked for order and summed up again per series."""
    pieces = track.series_chunks(
        events(spark, sf_dir), ["user_id", "event_type"], "ts", "value", ["event_id"],
        width(spark, sf_dir),
    )
    times = F.transform("data", lambda x: x["time"])
    micros = lambda c: F.round(c * 1_000_000).cast("bigint")
    return pieces.groupBy("user_id", "event_type").agg(
        F.sum(F.size("data")).alias("n"),
        F.every(times == F.array_sort(times)).alias("in_order"),
        F.min(micros(F.element_at(times, 1))).alias("first_us"),
        F.max(micros(F.element_at(times, -1))).alias("last_us"),
        F.sum(
            F.aggregate(
                "data", F.lit(0).cast("bigint"),
                lambda a, x: a + F.round(x["value"] * 100).cast("bigint"),
            )
        ).alias("cents"),
    )


@query(with_(MSG, select="SELECT count(DISTINCT icao) AS planes, max(us) AS last_us FROM m"))
def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track.tracked(messages(spark, sf_dir))
    return t.select("planes", us("last_update").alias("last_us"))


_TOP = "ORDER BY packets DESC, first_us, icao LIMIT 5"
_STATS = """s AS (
  SELECT icao, count(*) AS packets, min(us) AS first_us,
    arg_max(callsign, (us, event_id)) FILTER (WHERE callsign IS NOT NULL) AS callsign
  FROM m GROUP BY icao),
h AS (SELECT icao, '{' || string_agg(type_cat || ': ' || n, ', ' ORDER BY type_cat) || '}' AS types
      FROM (SELECT icao, type_cat, count(*) AS n FROM m GROUP BY ALL) GROUP BY icao)"""
_LINE = """CASE WHEN callsign IS NOT NULL THEN icao || '/' || callsign ELSE icao || ',' END
      || ' (' || packets || ', ' || types || ')'"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return (
        track.plane_stats(m)
        .join(track.packet_types(m), "icao")
        .join(track.plane_info(m, tie=["event_id"]), "icao")
    )


@query(with_(MSG, _STATS, select=f"SELECT icao, packets FROM s {_TOP}"))
def top_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.top_planes(track.plane_stats(messages(spark, sf_dir)), 5).select("icao", "packets")


@query(with_(MSG, _STATS, select=f"SELECT icao, {_LINE} AS line FROM s JOIN h USING (icao)"))
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.status_lines(_statistics(spark, sf_dir), -1).select("icao", "line")


@query(with_(MSG, _STATS, select=f"""
    , t AS (SELECT * FROM s JOIN h USING (icao) {_TOP})
    SELECT 'Top ' || count(*) || ': ' || string_agg({_LINE}, ', '
      ORDER BY packets DESC, first_us, icao) AS message FROM t"""))
def status_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.status_message(track.status_lines(_statistics(spark, sf_dir), 5), 5)


DEDUP = f"""d AS (SELECT user_id, us, min(event_id) AS event_id FROM ev GROUP BY user_id, us),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM d),
nx AS (
  SELECT a.user_id, a.us, a.event_id, min(b.us) AS next_us FROM o a
  LEFT JOIN o b ON b.user_id = a.user_id AND b.us > a.us + {GAP_US} GROUP BY ALL),
kept AS (
  SELECT nx.* FROM nx JOIN o ON o.user_id = nx.user_id AND o.us = nx.us AND o.rn = 1
  UNION ALL
  SELECT nx.* FROM kept JOIN nx ON nx.user_id = kept.user_id AND nx.us = kept.next_us)"""


@query(
    with_(EV, DEDUP, select="SELECT event_id, user_id FROM kept").replace(
        "WITH ", "WITH RECURSIVE ", 1
    )
)
def dedup_within(spark: SparkSession, sf_dir: str, dedup=dedup_within) -> DataFrame:
    e = events(spark, sf_dir)
    kept = dedup(e, "user_id", "ts", SIX_HOURS, ["event_id"], width(spark, sf_dir))
    return kept.select("event_id", "user_id")


@query(with_(EV, select="SELECT event_id, event_type AS receiver, us FROM ev"))
def receivers_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receiver per kind of event, merged back together."""
    e = events(spark, sf_dir)
    # Receivers are separate feeds: the kinds of event in the table stand for them.
    kinds = sorted(r.event_type for r in e.select("event_type").distinct().collect())
    parts = [
        e.filter(F.col("event_type") == k).select("event_id", F.lit(k).alias("receiver"), us("ts").alias("us"))
        for k in kinds
    ]
    return union_receivers(*parts)
