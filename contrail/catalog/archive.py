"""Registered queries: flight qualification, thinning, archive and its queries."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.catalog.base import (
    DAY,
    EV,
    FLIGHT_MSG,
    HOUR,
    MSG,
    SIX_HOURS,
    events,
    flight_width,
    messages,
    table,
    us,
    width,
    with_,
)
from contrail.catalog.rules import _LEVELS_SQL, _RULE_SQL
from contrail.catalog.track import FLIGHTS, MOTION
from contrail.catalog.zones import CONFIG, RINGS, eta_sql
from contrail.operators import qualify as ql
from contrail.operators import track
from contrail.operators.intervals import TICKS, state_intervals
from contrail.operators.rules import load_rules
from contrail.plans import browse
from contrail.plans.archiving import archive_flights
from contrail.schema import MAX_TIME_SECONDS
from contrail.sources.archive import Archive, read_archive, write_archive
from contrail.sources.scratch import materialize, new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The zone rules with one save rule of every kind.
SAVING = copy.deepcopy(CONFIG)
SAVING["categories"]["quiet"]["save"] = {
    "telemetry": {"default": "all", "altitude": "none", "latitude": "decimate(3)"},
    "calculated": {"default": "sdecimate(1, 86400)"},
}
SAVING["categories"]["loud"]["save"] = {
    "telemetry": {"default": "decimate(2)", "longitude": "sdecimate(2,172800)"},
    "calculated": {"default": "none", "direction": "all"},
}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


SERIES = """ser AS MATERIALIZED (
  WITH r AS (SELECT * FROM (
      SELECT icao, us, event_id, unnest(['latitude', 'longitude', 'altitude', 'vertical_speed',
          'horizontal_speed', 'direction']) AS type,
        unnest([latitude, longitude, altitude, vertical_speed, horizontal_speed, direction]) AS value
      FROM m) WHERE value IS NOT NULL),
  c AS (SELECT icao, us, event_id, speed_us, unnest(['horizontal_speed', 'direction']) AS type,
      unnest([speed, heading]) AS value FROM states)
  SELECT icao, 'received_data' AS category, type, us, event_id, value FROM (
    SELECT *, lag(value) OVER (PARTITION BY icao, type ORDER BY us, event_id) AS lv FROM r)
  WHERE lv IS NULL OR lv <> value
  UNION ALL
  SELECT icao, 'calculated_data', type, speed_us, event_id, value FROM (
    SELECT *, lag(value) OVER w AS lv, lag(speed_us) OVER w AS lu FROM c
    WINDOW w AS (PARTITION BY icao, type ORDER BY us, event_id))
  WHERE lv IS NULL OR lv <> value OR lu <> speed_us)"""


def _near(category: str, datum: str, name: str) -> str:
    return (
        "arg_min(s.value, abs(s.us - t.us) * 2 + CASE WHEN s.us < t.us THEN 1 ELSE 0 END) "
        f"FILTER (WHERE s.category = '{category}' AND s.type = '{datum}') AS {name}"
    )


HOURLY = [
    """ticks AS MATERIALIZED (SELECT icao, k * 3600000000 AS us, row_number() OVER () AS event_id FROM (
      SELECT icao, unnest(generate_series(min(us) // 3600000000 + 1, max(us) // 3600000000)) AS k
      FROM m GROUP BY icao))""",
    """u AS MATERIALIZED (SELECT icao, category, type, us, arg_max(value, event_id) AS value
      FROM ser GROUP BY ALL)""",
    "st AS MATERIALIZED (SELECT * FROM (SELECT t.event_id, t.icao, t.us, "
    + ", ".join([
        *[_near("received_data", d, d) for d in ("latitude", "longitude", "altitude", "vertical_speed")],
        _near("calculated_data", "horizontal_speed", "speed"),
        _near("calculated_data", "direction", "heading"),
    ])
    + " FROM ticks t JOIN u s ON s.icao = t.icao GROUP BY t.event_id, t.icao, t.us)"
    " WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND heading IS NOT NULL)",
]
QUALIFIED = [
    *FLIGHT_MSG, MOTION, SERIES, *HOURLY, *eta_sql("st", MAX_TIME_SECONDS, RINGS), _LEVELS_SQL,
    f"""ok AS MATERIALIZED (SELECT e.icao, e.zone, l.level,
      count(*) FILTER (WHERE {_RULE_SQL}) AS valid_seconds, min(e.eta) AS min_eta
    FROM z e JOIN l ON l.zone = e.zone GROUP BY ALL
    HAVING count(*) FILTER (WHERE {_RULE_SQL})
      >= CASE l.level WHEN 'warn' THEN 60 WHEN 'alert' THEN 30 ELSE 2 END)""",
]
_SPLIT = """CAST(split_part(icao, ':', 1) AS BIGINT) AS icao,
      CAST(split_part(icao, ':', 2) AS BIGINT) AS start_us"""


def flight_messages(spark: SparkSession, sf_dir: str, slice_seconds: float | None = None) -> DataFrame:
    return track.flights(messages(spark, sf_dir), "icao", "ts", DAY, slice_seconds or width(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str, w: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, received series and calculated series of all flights."""
    m = flight_messages(spark, sf_dir, w)
    keys = ["icao", "flight_start"]
    m = materialize(m, "messages")
    states = materialize(track.motion(m, 10, SIX_HOURS, keys, "ts", ["event_id"], w), "states")
    received = track.received_series(m, keys, "ts", ["event_id"], slice_seconds=w)
    return m, received, track.calculated_series(states, keys, "ts", ["event_id"], w)


def _bounds(m: DataFrame) -> DataFrame:
    return m.groupBy("icao", "flight_start").agg(F.max("ts").alias("flight_end"))


def _states(spark: SparkSession, sf_dir: str, make=ql.second_states, step: int = HOUR) -> DataFrame:
    # Rows without an aircraft or time are in no flight's state; stretches may go over slices of any width.
    w = flight_width(spark, sf_dir) if make is state_intervals else width(spark, sf_dir)
    m, received, calculated = _series(spark, sf_dir, w)
    keys = ["icao", "flight_start"]
    wide = materialize(ql.wide_series(received, calculated, keys, "ts", ["event_id"]), "series")
    return make(_bounds(m), wide, keys, "ts", ["event_id"], step, w)


@query(with_(*FLIGHT_MSG, select=f"""
    SELECT {_SPLIT}, unnest(generate_series(min(us) // 3600000000 + 1, max(us) // 3600000000))
      * 3600000000 AS us FROM m GROUP BY m.icao"""))
def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks between the first and the last message of every flight."""
    m = flight_messages(spark, sf_dir)
    g = ql.second_grid(_bounds(m), step_seconds=HOUR, slice_seconds=width(spark, sf_dir))
    return g.select("icao", us("flight_start").alias("start_us"), us("ts").alias("us"))


@query(with_(*FLIGHT_MSG, MOTION, SERIES, *HOURLY, select=f"""
    SELECT {_SPLIT}, us, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, altitude,
      vertical_speed, round(speed, 3) AS speed, round(heading, 3) AS heading FROM st"""))
def hourly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-in-time state of every series at every tick."""
    return _states(spark, sf_dir).select(
        "icao", us("flight_start").alias("start_us"), us("ts").alias("us"),
        F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
        "altitude", "vertical_speed", F.round("speed", 3).alias("speed"),
        F.round("heading", 3).alias("heading"),
    )


@query(with_(*QUALIFIED, select=f"""
    SELECT {_SPLIT}, zone, level, valid_seconds,
      CASE WHEN isinf(min_eta) THEN -1.0 ELSE round(min_eta, 2) END AS min_eta FROM ok"""))
def qualified_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels met long enough by a flight, with its smallest time to enter the zone; ticks of an hour."""
    return _qualified(_states(spark, sf_dir, state_intervals))


def _qualified(stretches: DataFrame) -> DataFrame:
    q = ql.qualify(stretches, load_rules(SAVING), weight=TICKS)
    eta = F.when(F.abs("min_eta") < float("inf"), F.round("min_eta", 2)).otherwise(-1.0)
    return q.select(
        "icao", us("flight_start").alias("start_us"), "zone", "level", "valid_seconds",
        eta.alias("min_eta"),
    )


# Stretches between switching points of any series, each with its number of seconds; the state at
# its first second is searched among all samples of the flight, as for the hourly ticks.
_SWITCH = """ends AS (SELECT icao, min(us) // 1000000 + 1 AS lo, max(us) // 1000000 AS hi FROM m GROUP BY icao),
  half AS (SELECT icao, (us + lag(us) OVER (PARTITION BY icao, category, type ORDER BY us) + 1999999) // 2000000 AS k
    FROM u WHERE (category, type) IN (('received_data', 'latitude'), ('received_data', 'longitude'), ('received_data', 'altitude'),
      ('received_data', 'vertical_speed'), ('calculated_data', 'horizontal_speed'), ('calculated_data', 'direction'))),
  ticks AS MATERIALIZED (SELECT icao, k * 1000000 AS us, row_number() OVER () AS event_id,
      coalesce(lead(k) OVER (PARTITION BY icao ORDER BY k), hi + 1) - k AS ticks
    FROM (SELECT icao, lo AS k, hi FROM ends WHERE lo <= hi
      UNION SELECT icao, k, hi FROM half JOIN ends USING (icao) WHERE k > lo AND k <= hi))"""
SECONDS = [
    *FLIGHT_MSG, MOTION, SERIES, HOURLY[1], _SWITCH,
    HOURLY[2].replace("SELECT t.event_id, t.icao, t.us, ", "SELECT t.event_id, t.icao, t.us, any_value(t.ticks) AS ticks, ", 1),
    *eta_sql("st", MAX_TIME_SECONDS, RINGS), _LEVELS_SQL,
    f"""ok AS MATERIALIZED (SELECT e.icao, e.zone, l.level,
      sum(e.ticks) FILTER (WHERE {_RULE_SQL})::BIGINT AS valid_seconds, min(e.eta) AS min_eta
    FROM z e JOIN l ON l.zone = e.zone GROUP BY ALL
    HAVING sum(e.ticks) FILTER (WHERE {_RULE_SQL})
      >= CASE l.level WHEN 'warn' THEN 60 WHEN 'alert' THEN 30 ELSE 2 END)""",
]


@query(with_(*SECONDS, select=f"""
    SELECT {_SPLIT}, zone, level, valid_seconds,
      CASE WHEN isinf(min_eta) THEN -1.0 ELSE round(min_eta, 2) END AS min_eta FROM ok"""))
def qualified_by_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the grid of seconds."""
    return _qualified(_states(spark, sf_dir, state_intervals, 1))


@query(with_(EV, select="""
    SELECT event_id FROM (SELECT event_id, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn FROM ev) WHERE (rn - 1) % 10 = 0"""))
def thin_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    e = events(spark, sf_dir)
    return ql.decimate(e, keys, "ts", 10, ["event_id"], width(spark, sf_dir)).select("event_id")


@query(with_(EV, select="""
    SELECT event_id FROM (SELECT event_id, row_number() OVER (
        PARTITION BY user_id, event_type, (us - t0) // 259200000000 ORDER BY us, event_id) AS rn
      FROM (SELECT *, min(us) OVER (PARTITION BY user_id, event_type) AS t0 FROM ev)) WHERE rn <= 2"""))
def thin_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    e = events(spark, sf_dir)
    kept = ql.sdecimate(e, keys, "ts", 2, 3 * DAY, ["event_id"], width(spark, sf_dir))
    return kept.select("event_id")


_KEPT = """kept AS (
  SELECT icao, category, type, us, event_id, value, zone, level FROM (
    SELECT s.*, ok.zone, ok.level, s.rn, s.b1, s.b2 FROM (
      SELECT *, row_number() OVER (PARTITION BY icao, category, type ORDER BY us, event_id) AS rn,
        row_number() OVER (PARTITION BY icao, category, type, (us - t0) // 86400000000
          ORDER BY us, event_id) AS b1,
        row_number() OVER (PARTITION BY icao, category, type, (us - t0) // 172800000000
          ORDER BY us, event_id) AS b2
      FROM (SELECT *, min(us) OVER (PARTITION BY icao, category, type) AS t0 FROM ser)) s
    JOIN ok ON ok.icao = s.icao)
  WHERE CASE
    WHEN zone = 'wedge' THEN true
    WHEN level = 'alert' AND category = 'received_data'
      THEN CASE type WHEN 'longitude' THEN b2 <= 2 ELSE (rn - 1) % 2 = 0 END
    WHEN level = 'alert' THEN type = 'direction'
    WHEN category = 'received_data'
      THEN CASE type WHEN 'altitude' THEN false WHEN 'latitude' THEN (rn - 1) % 3 = 0 ELSE true END
    ELSE b1 <= 1 END)"""


def _archive(spark: SparkSession, sf_dir: str) -> Archive:
    m = flight_messages(spark, sf_dir).withColumn("icao", F.col("icao").cast("string"))
    return archive_flights(
        materialize(m, "messages"), load_rules(SAVING), 10, SIX_HOURS,
        tie=["event_id"], slice_seconds=width(spark, sf_dir), step_seconds=HOUR,
    )


_ID = """split_part(icao, ':', 1) AS icao,
      CAST(CAST(split_part(icao, ':', 2) AS BIGINT) // 1000000 AS VARCHAR) || '-' || zone || '-' || level
        AS flight_id"""


@query(with_(*QUALIFIED, _KEPT, select=f"""
    SELECT {_ID}, c.category, c.type, count(k.us) AS n, min(k.us) AS first_us, max(k.us) AS last_us,
      CAST(coalesce(sum(CAST(round(k.value * 10) AS BIGINT)), 0) AS BIGINT) AS tenths
    FROM (SELECT ok.*, t.category, t.type FROM ok CROSS JOIN (VALUES
        ('received_data', 'latitude'), ('received_data', 'longitude'), ('received_data', 'altitude'),
        ('received_data', 'vertical_speed'), ('received_data', 'horizontal_speed'),
        ('received_data', 'direction'), ('calculated_data', 'horizontal_speed'),
        ('calculated_data', 'direction')) AS t(category, type)) c
    LEFT JOIN kept k USING (icao, zone, level, category, type) GROUP BY ALL"""))
def archived_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved of every qualified flight, by the save rule of each level."""
    a = _archive(spark, sf_dir)
    time = F.transform("data", lambda x: F.round(x["time"] * 1_000_000).cast("bigint"))
    total = F.aggregate(
        "data", F.lit(0).cast("bigint"),
        lambda s, x: s + F.round(x["value"] * 10).cast("bigint"),
    )
    return a.series.groupBy("icao", "flight_id", "category", "type").agg(
        F.sum(F.size("data")).alias("n"), F.min(F.array_min(time)).alias("first_us"),
        F.max(F.array_max(time)).alias("last_us"), F.sum(total).alias("tenths"),
    )


_INFO = """i AS (SELECT icao, count(*) AS packets, min(us) AS first_us, max(us) AS last_us,
    arg_max(callsign, (us, event_id)) FILTER (WHERE callsign IS NOT NULL) AS callsign,
    count(*) FILTER (WHERE type_cat = 3) AS fixes FROM m GROUP BY icao)"""


ARCHIVED = with_(*QUALIFIED, _INFO, select=f"""
    SELECT {_ID}, zone, level, packets, first_us, last_us, callsign, fixes
    FROM ok JOIN i USING (icao)""")


@query(ARCHIVED)
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive written as tables and read back."""
    path = new_path(spark, "archive")
    write_archive(_archive(spark, sf_dir), path, "first")
    info = read_archive(spark, path).info
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    return info.select(
        "icao", "flight_id", "zone", "level", "packets", micros("first_packet").alias("first_us"),
        micros("last_update").alias("last_us"), "callsign",
        F.coalesce(F.try_element_at("packet_type", F.lit("3")), F.lit(0)).alias("fixes"),
    )


# The shell verbs, over an archive that holds every flight of the event table.

def event_archive(spark: SparkSession, sf_dir: str) -> Archive:
    w = width(spark, sf_dir)
    e = track.flights(events(spark, sf_dir), "user_id", "ts", DAY, w).withColumns({
        "icao": F.col("user_id").cast("string"),
        "flight_id": F.concat_ws(
            "-", F.floor(us("flight_start") / 1_000_000).cast("string"), F.lit("all"), F.lit("seen")
        ),
    })
    rows = e.withColumns({"category": F.lit("received_data"), "type": F.col("event_type")})
    keys = ["icao", "flight_id", "category", "type"]
    series = track.series_chunks(rows, keys, "ts", "value", ["event_id"], w)
    kinds = e.groupBy("icao", "flight_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    kinds = kinds.groupBy("icao", "flight_id").agg(F.map_from_entries(entries).alias("packet_type"))
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    info = e.groupBy("icao", "flight_id").agg(
        F.lit("all").alias("zone"), F.lit("seen").alias("level"),
        last(F.concat(F.lit("C"), (F.col("event_id") % 100).cast("string"))).alias("callsign"),
        last(F.array(F.lit(4), (F.col("event_id") % 8).cast("int"))).alias("plane_category"),
        (F.min(us("ts")) / 1e6).alias("first_packet"), (F.max(us("ts")) / 1e6).alias("last_update"),
        F.count(F.lit(1)).alias("packets"),
    )
    return Archive(series, info.join(kinds, ["icao", "flight_id"]))


DAY_FLIGHTS = FLIGHTS.replace(str(SIX_HOURS * 1_000_000), str(DAY * 1_000_000))
FID = """g AS (SELECT *, CAST(user_id AS VARCHAR) AS icao,
    CAST(start_us // 1000000 AS VARCHAR) || '-all-seen' AS flight_id FROM f)"""
A = [EV, DAY_FLIGHTS, FID]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    text = lambda c: F.col(c).cast("string")
    return c.select(
        text("c_custkey").alias("icao"), F.col("c_custkey").alias("line_no"),
        text("c_mktsegment").alias("callsign"), text("n_name").alias("country"),
        text("c_nationkey").alias("built"), text("c_mktsegment").alias("manufacturer_icao"),
        text("n_name").alias("manufacturer_name"), text("c_mktsegment").alias("model"),
        text("c_name").alias("owner"),
    )


@query(with_(*A, select="""
    SELECT count(DISTINCT icao) AS planes, count(DISTINCT (icao, flight_id)) AS flights,
      count(*) * 16 AS bytes FROM g"""))
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.archive_status(event_archive(spark, sf_dir))


@query(with_(*A, select="SELECT icao, count(DISTINCT flight_id) AS flights FROM g GROUP BY icao"))
def archive_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_planes(event_archive(spark, sf_dir))


@query(with_(*A, select="SELECT DISTINCT icao, flight_id FROM g WHERE icao = '8'"))
def archive_flights_of_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.list_flights(event_archive(spark, sf_dir), "8")


_NEWEST = """w AS (SELECT icao, flight_id, min(us) AS first_us, max(us) AS last_us,
    arg_max(event_id, (us, event_id)) AS last_id FROM g GROUP BY ALL),
  nw AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY icao ORDER BY first_us DESC) = 1)"""


@query(with_(*A, _NEWEST, select="""
    SELECT nw.icao, flight_id, 'C' || last_id % 100 AS callsign, (last_us - first_us) // 1000 AS millis,
      c_mktsegment AS model, c_name AS owner, n_name AS country
    FROM nw LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = nw.icao
    LEFT JOIN nation ON n_nationkey = c_nationkey"""))
def plane_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest flight of every aircraft with its registry entry."""
    cards = browse.plane_card(event_archive(spark, sf_dir), registry(spark, sf_dir))
    return cards.select(
        "icao", "flight_id", "callsign",
        F.floor(F.round(F.col("duration") * 1_000_000) / 1000).alias("millis"),
        "model", "owner", "country",
    )


@query(with_(*A, _NEWEST, select="""
    SELECT a.icao, a.flights, a.bytes, a.first_us, a.last_us, (nw.last_us - nw.first_us) // 1000 AS millis,
      CASE nw.last_id % 8 WHEN 1 THEN 'Light (<7000kg)' WHEN 2 THEN 'Medium 1 (7000 to 34000kg)'
        WHEN 3 THEN 'Medium 2 (34000 to 136000kg)' WHEN 4 THEN 'High vortex aircraft'
        WHEN 5 THEN 'Heavy (>13600kg)' WHEN 6 THEN 'High performance (>5g) and high speed (>740km/h)'
        WHEN 7 THEN 'Rotorcraft (helicopter)' END AS category_label,
      a.clicks, (SELECT count(*) FILTER (WHERE event_type = 'click') FROM g
        WHERE g.icao = nw.icao AND g.flight_id = nw.flight_id) AS recent_clicks
    FROM (SELECT icao, count(DISTINCT flight_id) AS flights, count(*) * 16 AS bytes, min(us) AS first_us,
        max(us) AS last_us, count(*) FILTER (WHERE event_type = 'click') AS clicks
      FROM g GROUP BY icao) a JOIN nw USING (icao)"""))
def plane_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = browse.plane_summary(event_archive(spark, sf_dir))
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    clicks = lambda m: F.coalesce(F.try_element_at(m, F.lit("click")), F.lit(0))
    return s.select(
        "icao", "flights", "bytes", micros("first_seen").alias("first_us"),
        micros("last_seen").alias("last_us"),
        F.floor(F.round(F.col("last_duration") * 1_000_000) / 1000).alias("millis"),
        "category_label", clicks("packet_type_overall").alias("clicks"),
        clicks("packet_type_recent").alias("recent_clicks"),
    )


def _dumped(rows: DataFrame) -> DataFrame:
    entries = F.map_entries("content")
    found = rows.select(
        "icao", "flight_id", F.inline_outer(entries), F.col("info.packets").alias("packets")
    )
    return found.groupBy("icao", "flight_id", F.coalesce("key", F.lit("info")).alias("type")).agg(
        F.sum(F.coalesce(F.size("value").cast("bigint"), "packets")).alias("n")
    )


def _dump_sql(where: str) -> str:
    return with_(*A, select=f"""
    SELECT icao, flight_id, event_type AS type, count(*) AS n FROM g {where} GROUP BY ALL
    UNION ALL SELECT icao, flight_id, 'info', count(*) FROM g {where} GROUP BY ALL""")


@query(_dump_sql(""))
def dump_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumped(browse.dump(event_archive(spark, sf_dir)))


@query(_dump_sql("WHERE icao = '8'"))
def dump_one_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dumped(browse.dump(event_archive(spark, sf_dir), "8"))


@query(_dump_sql("WHERE icao = '8' AND flight_id = (SELECT min(flight_id) FROM g WHERE icao = '8')"))
def dump_one_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flight of one aircraft."""
    a = event_archive(spark, sf_dir)
    first = browse.list_flights(a, "8").agg(F.min("flight_id").alias("flight_id"))
    one = Archive(*(df.join(first, "flight_id", "left_semi") for df in (a.series, a.info)))
    return _dumped(browse.dump(one, "8"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS icao, c_name AS owner, n_name AS country FROM customer
    JOIN nation ON n_nationkey = c_nationkey""")
def dump_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.dump_registry(registry(spark, sf_dir)).select("icao", "owner", "country")


@query(with_(*A, select="""
    SELECT icao, count(DISTINCT flight_id) AS flights FROM g
    WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY icao"""))
def archive_without_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("icao"))
    return browse.list_planes(browse.without_plane(event_archive(spark, sf_dir), gone))
