"""Inputs shared by the registered queries: the event table seen as aircraft messages."""

from __future__ import annotations

import functools
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.slices import fit_slice_seconds

HOUR = 3600
SIX_HOURS = 6 * HOUR
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a timestamp that means UTC in any session time zone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(us))


@functools.cache
def _width(application: str, sf_dir: str) -> float:
    spark = SparkSession.getActiveSession()
    return fit_slice_seconds(events(spark, sf_dir), "user_id", "ts")


def width(spark: SparkSession, sf_dir: str) -> float:
    """Slice width for the event table, measured once per session."""
    return _width(spark.sparkContext.applicationId, sf_dir)


@functools.cache
def _flight_width(application: str, sf_dir: str) -> float:
    spark = SparkSession.getActiveSession()
    longer = (400.0 * DAY, 100.0 * DAY, 25.0 * DAY, 5.0 * DAY, float(DAY))
    return fit_slice_seconds(events(spark, sf_dir), "user_id", "ts", 50_000, longer)


def flight_width(spark: SparkSession, sf_dir: str) -> float:
    """Slice width for whole flights: over a day where few messages of an aircraft fall on a day.

    A slice of one or two rows costs as much as its rows; up to a tenth of what ``width`` allows
    goes into one of these.
    """
    wide = _flight_width(spark.sparkContext.applicationId, sf_dir)
    return wide if wide > DAY else width(spark, sf_dir)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one decoded message of the aircraft ``user_id``.

    Views and clicks are positions on a track that moves every six hours, purchases are
    velocities, signups identifications, everything else a sign of life.
    """
    e = events(spark, sf_dir)
    step = F.floor(F.unix_micros("ts") / (SIX_HOURS * 1_000_000))
    fix = F.col("event_type").isin("view", "click")
    moves = F.col("event_type") == "purchase"
    named = F.col("event_type") == "signup"
    n = F.col("event_id")
    return e.select(
        "event_id",
        F.col("user_id").alias("icao"),
        "ts",
        F.when(fix, 3).when(moves, 5).when(named, 1).otherwise(0).alias("type_cat"),
        F.when(named, F.concat(F.lit("F"), (n % 500).cast("string"))).alias("callsign"),
        F.when(named, F.lit(4)).alias("cat_tc"),
        F.when(named, (n % 8).cast("int")).alias("cat_ca"),
        F.when(
            fix, F.lit(35.0) + ((F.col("user_id") * 31 + step * 7) % 997).cast("double") / 997
        ).alias("latitude"),
        F.when(
            fix, F.lit(-79.0) + ((F.col("user_id") * 17 + step * 11) % 991).cast("double") / 991
        ).alias("longitude"),
        F.when(fix, (n * 37 % 12000).cast("double")).alias("altitude"),
        F.when(moves, (100 + n % 800).cast("double")).alias("horizontal_speed"),
        F.when(moves, (n * 7 % 360).cast("double")).alias("direction"),
        F.when(moves, (n % 41 - 20).cast("double") / 2).alias("vertical_speed"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one position with speed and heading, for the zone queries."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.lit(35.0) + (n % 997).cast("double") / 997).alias("latitude"),
        (F.lit(-79.0) + (n * 31 % 991).cast("double") / 991).alias("longitude"),
        (100 + n % 800).cast("double").alias("speed"),
        (n * 7 % 360).cast("double").alias("heading"),
    )


def us(col: str) -> F.Column:
    return F.unix_micros(col)


# SQL counterparts -----------------------------------------------------------------------

EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events)"

MSG = """m AS (
  SELECT event_id, user_id AS icao, epoch_us(ts) AS us,
    CASE WHEN event_type IN ('view','click') THEN 3 WHEN event_type = 'purchase' THEN 5
         WHEN event_type = 'signup' THEN 1 ELSE 0 END AS type_cat,
    CASE WHEN event_type = 'signup' THEN 'F' || CAST(event_id % 500 AS VARCHAR) END AS callsign,
    CASE WHEN event_type = 'signup' THEN 4 END AS cat_tc,
    CASE WHEN event_type = 'signup' THEN event_id % 8 END AS cat_ca,
    CASE WHEN event_type IN ('view','click') THEN 35.0::DOUBLE +
      CAST((user_id * 31 + (epoch_us(ts) // 21600000000) * 7) % 997 AS DOUBLE) / 997 END AS latitude,
    CASE WHEN event_type IN ('view','click') THEN -79.0::DOUBLE +
      CAST((user_id * 17 + (epoch_us(ts) // 21600000000) * 11) % 991 AS DOUBLE) / 991 END AS longitude,
    CASE WHEN event_type IN ('view','click') THEN CAST(event_id * 37 % 12000 AS DOUBLE) END AS altitude,
    CASE WHEN event_type = 'purchase' THEN CAST(100 + event_id % 800 AS DOUBLE) END AS horizontal_speed,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id * 7 % 360 AS DOUBLE) END AS direction,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 41 - 20 AS DOUBLE) / 2 END AS vertical_speed
  FROM events)"""

POS = """p AS (
  SELECT event_id,
    35.0::DOUBLE + CAST(event_id % 997 AS DOUBLE) / 997 AS latitude,
    -79.0::DOUBLE + CAST(event_id * 31 % 991 AS DOUBLE) / 991 AS longitude,
    CAST(100 + event_id % 800 AS DOUBLE) AS speed,
    CAST(event_id * 7 % 360 AS DOUBLE) AS heading
  FROM events)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + textwrap.dedent(select)


_A = "6378.137::DOUBLE"
_F = "(1 / 298.257223563::DOUBLE)"


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Ellipsoidal distance as an SQL expression."""
    b1 = f"atan((1 - {_F}) * tan(radians({lat1})))"
    b2 = f"atan((1 - {_F}) * tan(radians({lat2})))"
    h = (
        f"(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * "
        f"pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    s = f"(2 * asin(sqrt({h})))"
    p, q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    x = f"(({s} - sin({s})) * pow(sin({p}) * cos({q}), 2) / pow(cos({s} / 2), 2))"
    y = f"(({s} + sin({s})) * pow(cos({p}) * sin({q}), 2) / pow(sin({s} / 2), 2))"
    return f"(CASE WHEN {h} = 0 THEN 0.0 ELSE {_A} * ({s} - {_F} / 2 * ({x} + {y})) END)"


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b, d = f"radians({lat1})", f"radians({lat2})", f"radians({lon2} - {lon1})"
    return (
        f"((degrees(atan2(sin({d}) * cos({b}), "
        f"cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d}))) + 360) % 360)"
    )


# Messages per flight (a day of silence ends one), their series and hourly states.
FLIGHT_MSG = [
    MSG.replace("m AS (", "m0 AS (", 1),
    f"""fm AS (SELECT *, max(CASE WHEN opens THEN us END) OVER (PARTITION BY icao
      ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS start_us FROM (
        SELECT *, coalesce(us - lag(us) OVER (PARTITION BY icao ORDER BY us, event_id)
          > {DAY * 1_000_000}, true) AS opens FROM m0))""",
    "m AS (SELECT * REPLACE (icao || ':' || start_us AS icao) FROM fm)",
]
