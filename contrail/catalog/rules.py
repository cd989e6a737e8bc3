"""Registered queries: components, requirements, levels, alerts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.catalog.base import DAY, EV, FLIGHT_MSG, MSG, SIX_HOURS, messages, positions, table, us, width, with_
from contrail.catalog.track import MOTION, states
from contrail.catalog.zones import CONFIG, ETA, STATE_ETA
from contrail.operators import alerts as al
from contrail.operators import enrich, track
from contrail.operators.rules import (
    component_columns,
    level_hits,
    load_rules,
    requirement,
    rule_tables,
)
from contrail.operators.zones import rule_states
from contrail.plans import live
from contrail.plans.live import state_alerts
from contrail.sources.scratch import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(with_(MSG, select="""
    SELECT event_id,
      coalesce(altitude <= 1000, false) AS low,
      coalesce(horizontal_speed >= 300 AND horizontal_speed <= 600, false) AS cruising,
      coalesce(latitude >= 35.5 AND longitude <= -78.5, false) AS northwest
    FROM m"""))
def component_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min/max bounds over one and over two datums; a missing datum fails."""
    rules = load_rules({
        **CONFIG,
        "zones": {},
        "components": {
            "low": {"altitude": {"maximum": 1000}},
            "cruising": {"horizontal_speed": {"minimum": 300, "maximum": 600}},
            "northwest": {"latitude": {"minimum": 35.5}, "longitude": {"maximum": -78.5}},
        },
    })
    rows = messages(spark, sf_dir).withColumnRenamed("horizontal_speed", "speed")
    return rows.select("event_id", *[c.alias(n) for n, c in component_columns(rules).items()])


@query(with_(EV, select="""
    SELECT event_id FROM ev
    WHERE value <= 50 AND NOT (value >= 20 OR event_id % 7 * 100 >= 500)"""))
def requirement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = {
        "easy1": {"altitude": {"maximum": 50}},
        "hot": {"altitude": {"minimum": 20}},
        "late": {"horizontal_speed": {"minimum": 500}},
    }
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("altitude"),
        (F.col("event_id") % 7 * 100).cast("double").alias("speed"),
    )
    return rows.filter(requirement("easy1 and not (hot or late)", components)).select("event_id")


_RULE_SQL = """
    CASE l.requirements WHEN 'soon' THEN e.eta <= 1800
      WHEN 'soon and fast' THEN e.eta <= 1800 AND e.speed >= 500
      WHEN 'within or not fast' THEN e.distance_km <= 20 OR NOT e.speed >= 500 END"""

_LEVELS_SQL = """l AS (SELECT * FROM (VALUES
  ('square', 'warn', 'soon', 'print'), ('square', 'alert', 'soon and fast', 'kafka'),
  ('diamond', 'warn', 'within or not fast', 'print'), ('wedge', 'watch', 'soon', 'kafka'))
  AS t(zone, level, requirements, alert_method))"""


@query(with_(*ETA, _LEVELS_SQL, select=f"""
    SELECT e.event_id, e.zone, l.level, l.alert_method FROM z e JOIN l ON l.zone = e.zone
    WHERE {_RULE_SQL}"""))
def level_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions against every level of every zone, categories by name and inline."""
    rules = load_rules(CONFIG)
    hits = level_hits(rule_states(positions(spark, sf_dir), rules), rules)
    return hits.select("event_id", "zone", "level", "alert_method")


@query(with_(*ETA, _LEVELS_SQL, select=f"""
    SELECT l.zone, l.level, l.requirements, CASE l.level WHEN 'warn' THEN 60 WHEN 'alert' THEN 30
      ELSE 2 END::DOUBLE AS seconds, count(e.event_id) AS hits
    FROM l LEFT JOIN z e ON l.zone = e.zone AND {_RULE_SQL} GROUP BY ALL"""))
def rule_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule tables joined with the number of positions that meet each level."""
    rules = load_rules(CONFIG)
    hits = level_hits(rule_states(positions(spark, sf_dir), rules), rules)
    counts = hits.groupBy("zone", "level").agg(F.count("event_id").alias("hits"))
    levels = rule_tables(spark, CONFIG)["levels"].select("zone", "level", "requirements", "seconds")
    return levels.join(counts, ["zone", "level"], "left").fillna(0, ["hits"])


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_alerts(states(spark, sf_dir), load_rules(CONFIG))


_ALERTS = """a AS (
  SELECT e.icao, coalesce(e.callsign, '') AS callsign, l.level AS type, e.zone, e.eta, e.us,
    e.event_id, e.altitude, e.latitude, e.longitude, l.alert_method
  FROM z e JOIN l ON l.zone = e.zone WHERE """ + _RULE_SQL + ")"


# Flights are followed one by one: a day of silence ends one, and nothing is carried on.
ALERT_ROWS = """
    SELECT {icao} AS icao, callsign, type, zone,
      CASE WHEN isinf(eta) THEN -1.0 ELSE round(eta, 2) END AS eta,
      us, altitude, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM a"""


@query(with_(*FLIGHT_MSG, MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS,
             select=ALERT_ROWS.format(icao="CAST(split_part(icao, ':', 1) AS BIGINT)")))
def live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: messages to flights, motion, geofences, rules and alerts."""
    w = width(spark, sf_dir)
    m = materialize(track.flights(messages(spark, sf_dir), "icao", "ts", DAY, w), "messages")
    a = live.live_alerts(m, load_rules(CONFIG), 10, SIX_HOURS, tie=["event_id"], slice_seconds=w)
    return alert_rows(a)


def alert_rows(a: DataFrame) -> DataFrame:
    eta = F.when(F.abs("eta") < float("inf"), F.round("eta", 2)).otherwise(-1.0)
    return a.select(
        "icao", "callsign", "type", "zone", eta.alias("eta"), us("ts").alias("us"),
        F.col("payload.altitude").alias("altitude"),
        F.round("payload.latitude", 6).alias("latitude"),
        F.round("payload.longitude", 6).alias("longitude"),
    )


@query(with_(MSG, MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS, select="""
    SELECT icao, zone, type, min(us) AS us FROM a GROUP BY ALL"""))
def first_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.first_only(_alerts(spark, sf_dir)).select("icao", "zone", "type", us("ts").alias("us"))


@query(with_(MSG, MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS, select="""
    SELECT icao, zone, type, max(us) AS us FROM a GROUP BY icao, zone, type, us // 21600000000"""))
def alerts_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = al.per_tick(_alerts(spark, sf_dir), "6 hours")
    return rows.select("icao", "zone", "type", us("ts").alias("us"))


_JSON = """'"callsign":"' || callsign || '","type":"' || type || '","payload":{"altitude":'
   || coalesce(CAST(altitude AS VARCHAR), 'null') || ',"latitude":' || round(latitude, 3)
   || ',"longitude":' || round(longitude, 3) || '},"zone":"' || zone || '","eta":'
   || CASE WHEN isinf(eta) THEN 'null' ELSE CAST(round(eta, 2) AS VARCHAR) END || '}'"""


def _short(rows: DataFrame) -> DataFrame:
    p = F.col("payload")
    return rows.withColumns({
        "payload": F.struct(
            p["altitude"].alias("altitude"),
            F.round(p["latitude"], 3).alias("latitude"),
            F.round(p["longitude"], 3).alias("longitude"),
        ),
        "eta": F.round("eta", 2),
        "icao": F.col("icao").cast("string"),
    })


@query(with_(MSG, MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS, select=f"""
    SELECT type AS topic, CAST(icao AS VARCHAR) AS key, '{{' || {_JSON} AS value
    FROM a WHERE alert_method = 'kafka'"""))
def kafka_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(_alerts(spark, sf_dir)).filter("alert_method = 'kafka'")
    return al.to_kafka_rows(rows)


@query(with_(MSG, MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS, select=f"""
    SELECT type AS logger, '{{"icao":"' || icao || '",' || {_JSON} AS value
    FROM a WHERE alert_method = 'print'"""))
def printed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(_alerts(spark, sf_dir)).filter("alert_method = 'print'")
    return al.to_text(rows)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a registry that lists some aircraft several times."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        (F.col("c_custkey") % 120).cast("string").alias("icao"),
        F.col("c_custkey").alias("line_no"),
        F.col("c_name").alias("owner"),
        F.col("c_mktsegment").alias("model"),
    )


@query(with_(EV, select="""
    , r AS (SELECT c_custkey % 120 AS icao, arg_min(c_name, c_custkey) AS owner,
              arg_min(c_mktsegment, c_custkey) AS model FROM customer GROUP BY ALL)
    SELECT event_id, owner AS reg_owner, model AS reg_model FROM ev
    LEFT JOIN r ON r.icao = ev.user_id"""))
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("icao")
    )
    found = enrich.with_registry(rows, _registry(spark, sf_dir))
    return found.select("event_id", "reg_owner", "reg_model")


@query(with_(MSG, select="""
    SELECT event_id, coalesce(callsign, n_name, '') AS callsign FROM m
    LEFT JOIN nation ON n_nationkey = icao"""))
def callsign_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    registrations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("icao"), F.col("n_name").alias("registration")
    )
    rows = messages(spark, sf_dir).select(
        "event_id", F.col("icao").cast("string").alias("icao"), "callsign"
    )
    return enrich.with_callsign(rows, registrations).select("event_id", "callsign")


@query("""SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN nation ON n_nationkey = l_linenumber * 4""")
def lookup_of_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in which a quarter of all rows has one key; only such keys are spread."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 4).cast("long").alias("key"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return enrich.lookup(rows, names, "key", rows_per_task=10_000).select("l_orderkey", "l_linenumber", "n_name")


@query(with_(MSG, select="""
    SELECT event_id, CASE cat_ca WHEN 1 THEN 'Light (<7000kg)' WHEN 2 THEN 'Medium 1 (7000 to 34000kg)'
      WHEN 3 THEN 'Medium 2 (34000 to 136000kg)' WHEN 4 THEN 'High vortex aircraft'
      WHEN 5 THEN 'Heavy (>13600kg)' WHEN 6 THEN 'High performance (>5g) and high speed (>740km/h)'
      WHEN 7 THEN 'Rotorcraft (helicopter)' END AS category_label
    FROM m WHERE type_cat = 1"""))
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = messages(spark, sf_dir).filter("type_cat = 1")
    return enrich.with_category_label(named).select("event_id", "category_label")


@query(with_(EV, select="""
    SELECT event_id FROM ev WHERE user_id IN (SELECT o_custkey FROM orders)"""))
def known_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("icao"))
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("icao"))
    return enrich.known(rows, listed, "icao").select("event_id")
