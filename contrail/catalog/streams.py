"""Registered queries: streaming forms run over the event table, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.catalog.base import DAY, EV, FLIGHT_MSG, HOUR, MSG, SIX_HOURS, messages, us, width, with_
from contrail.catalog.decode import CPR, SURFACE_SPEED, VEL, N
from contrail.catalog.encode import frames
from contrail.catalog.archive import ARCHIVED, SAVING
from contrail.catalog.rules import _ALERTS, _LEVELS_SQL, ALERT_ROWS, alert_rows
from contrail.catalog.rules import SQL as RULES_SQL
from contrail.catalog.track import _LINE, _STATS, _TOP, FLIGHTS, MOTION
from contrail.catalog.track import SQL as TRACK_SQL
from contrail.catalog.zones import CONFIG, STATE_ETA
from contrail.operators.rules import load_rules
from contrail.sources.archive import read_archive
from contrail.sources.scratch import materialize, new_path
from contrail.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


class _Stream:
    """The event table as a stream, behind the interface the batch inputs use."""

    def __init__(self, spark: SparkSession) -> None:
        self.read = self
        self.spark = spark

    def parquet(self, path: str) -> DataFrame:
        schema = self.spark.read.parquet(path).schema
        folder, name = path.rsplit("/", 1)
        return self.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(_Stream(spark), sf_dir)


def _run(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Everything there is now, through a file sink."""
    path = new_path(spark, "out")
    jobs.start(df, jobs.table_sink(path), once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


FILES, LATE = 8, 3600
SLICE_ROWS = 4_000_000


def _feed(spark: SparkSession, rows: DataFrame, silence: int = 0) -> DataFrame:
    """Rows as a stream, one slice of time a micro-batch: in time order but for shuffling within ``LATE`` seconds.

    A slice is as many files as its rows are worth, and slices grow in number with the table. Behind
    them comes one row ``LATE`` seconds, one and ``silence`` after the newest, with nothing but its time and the
    aircraft -1: it takes the watermark past every row of the table, and never comes out itself.
    """
    path = new_path(spark, "feed")
    rows = materialize(rows.withColumn("at_us", us("ts")), "rows")
    low, high, n = rows.agg(F.min("at_us"), F.max("at_us"), F.count("*")).first()
    slices = max(FILES, n // SLICE_ROWS)
    step = (high - low + LATE * 1_000_000) // slices + 1
    late = F.col("event_id") * 7919 % LATE * 1_000_000
    rows = materialize(rows.withColumn("slice", F.floor((F.col("at_us") + late - low) / step)), "slices")
    least = rows.groupBy("slice").count().agg(F.min("count")).first()[0]
    files = FILES if least > 1000 * FILES else 1
    schema = rows.drop("slice", "at_us").schema
    for k in range(slices):
        part = rows.filter(F.col("slice") == k).drop("slice", "at_us")
        part.repartition(files).write.mode("append").parquet(path)
    last = rows.limit(1).select(*[
        (F.timestamp_micros(F.lit(high + (LATE + 1 + silence) * 1_000_000)) if f.name == "ts" else
         F.lit("-1" if f.name in ("icao", "hex") else None)).cast(f.dataType).alias(f.name) for f in schema
    ])
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


_DEDUP = TRACK_SQL["dedup_within"].replace("event_id, user_id FROM kept", "event_id, user_id AS icao FROM kept")


@query(f"SELECT event_id, icao, epoch_us(ts) AS us FROM ({_DEDUP}) JOIN events USING (event_id)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates merged over micro-batches of shuffled rows."""
    jobs.use_rocksdb(spark)
    m = _feed(spark, messages(spark, sf_dir).select("event_id", "icao", "ts"))
    kept = jobs.stream_dedup(m, "icao", "ts", SIX_HOURS, ["event_id"], f"{LATE} seconds")
    return _run(spark, kept).select("event_id", "icao", us("ts").alias("us"))


@query(with_(EV, FLIGHTS, select=f"""
    , b AS (SELECT user_id AS icao, start_us, max(us) AS end_us, count(*) AS packets FROM f GROUP BY ALL)
    SELECT * FROM b WHERE (end_us + {SIX_HOURS * 1_000_000} + 1) // 1000
      < (SELECT max(us) FROM ev) // 1000"""))
def stream_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed flights; those still open at the end of the stream are not out yet."""
    closed = jobs.stream_flights(_messages(spark, sf_dir), "icao", "ts", SIX_HOURS)
    out = _run(spark, closed)
    return out.select(
        "icao", us("flight_start").alias("start_us"), us("flight_end").alias("end_us"), "packets"
    )


@query(with_(MSG, _STATS, select=f"""
    SELECT icao, {_LINE} AS line FROM s JOIN h USING (icao) {_TOP}"""))
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "status")
    show = lambda lines, number: lines.write.mode("overwrite").parquet(path)
    jobs.stream_status(
        _messages(spark, sf_dir), show, 5, tie=["event_id"], once=True
    ).awaitTermination()
    return spark.read.parquet(path).select("icao", "line")


@query(RULES_SQL["live_alerts"])
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query over micro-batches of shuffled rows: the alerts of the batch, flight by flight."""
    jobs.use_rocksdb(spark)
    a = jobs.stream_alerts(
        _feed(spark, messages(spark, sf_dir)), load_rules(CONFIG), fresh_seconds=SIX_HOURS, remember_seconds=DAY,
        tie=["event_id"], lateness=f"{LATE} seconds",
    )
    return alert_rows(_run(spark, a))


# What the frames of the event table say, decoded.
FRAME_MSG = f"""m0 AS (WITH {N}, {CPR}, {VEL}
  SELECT event_id, icao, us, 'AB' || format('{{:04d}}', event_id % 10000) AS callsign, NULL::DOUBLE AS latitude,
    NULL::DOUBLE AS longitude, NULL::DOUBLE AS altitude, NULL::DOUBLE AS horizontal_speed, NULL::DOUBLE AS direction
  FROM n WHERE kind = 0 OR (kind = 7 AND turn = 3)
  UNION ALL SELECT event_id, icao, us, NULL, latitude, longitude,
    CASE kind WHEN 1 THEN (event_id * 13 % 2048 * 25 - 1000) * 0.3048::DOUBLE
      ELSE event_id * 17 % 4096 * 3.28084::DOUBLE * 0.3048::DOUBLE END, NULL, NULL
  FROM c WHERE kind = 1 OR (kind = 2 AND event_id * 17 % 4096 <> 0)
  UNION ALL SELECT event_id, icao, us, NULL, latitude, longitude, NULL, {SURFACE_SPEED}, event_id * 11 % 128 * 2.8125::DOUBLE
  FROM c WHERE kind = 5 AND mov BETWEEN 1 AND 124 AND event_id % 13 > 0
  UNION ALL SELECT event_id, v.icao, epoch_us(ts), NULL, NULL, NULL, NULL, knots * 1.852::DOUBLE, direction
  FROM v JOIN events USING (event_id) WHERE va <> 0 AND vb <> 0 AND vr <> 0 AND direction IS NOT NULL
  UNION ALL SELECT event_id, icao, us, NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE kind = 6 OR (kind = 7 AND turn IN (0, 1)))"""


@query(with_(FRAME_MSG, *FLIGHT_MSG[1:], MOTION, *STATE_ETA, _LEVELS_SQL, _ALERTS,
             select=ALERT_ROWS.format(icao="split_part(icao, ':', 1)")))
def stream_frame_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames of two receivers to alerts in one query: merged, decoded, followed, tested."""
    jobs.use_rocksdb(spark)
    f = frames(spark, sf_dir)
    second = f.withColumns({"receiver": F.lit("second"), "ts": F.col("ts") + F.expr("INTERVAL 2 SECONDS")})
    a = jobs.stream_frame_alerts(
        _feed(spark, f.unionByName(second)), load_rules(CONFIG), f"{LATE} seconds", fresh_seconds=SIX_HOURS,
        remember_seconds=DAY, tie=["event_id"], keep=["event_id"],
    )
    return alert_rows(_run(spark, a))


# Flights that six hours of silence have not ended a second behind the newest row.
_LIVE = [MSG, """o AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY icao ORDER BY us, event_id) > 21600000000, true) AS opens FROM m),
  f AS (SELECT *, sum(opens::INT) OVER (PARTITION BY icao ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM o),
  k AS (SELECT icao, n, type_cat, count(*) AS c FROM f GROUP BY ALL),
  s AS (SELECT icao, count(*) AS packets, min(us) AS first_us, max(us) AS last_us,
      arg_max(callsign, (us, event_id)) FILTER (WHERE callsign IS NOT NULL) AS callsign,
      (SELECT '{' || string_agg('"' || type_cat || '": ' || c, ', ' ORDER BY type_cat) || '}' FROM k WHERE k.icao = f.icao AND k.n = f.n) AS kinds
    FROM f GROUP BY icao, n HAVING max(us) + 21600000000 >= (SELECT max(us) + 1000000 FROM m) // 1000 * 1000)"""]


@query(with_(*_LIVE, select="""
    SELECT (SELECT count(*) FROM s) AS live, icao, packets, callsign, first_us, last_us, kinds
    FROM s ORDER BY packets DESC, first_us, icao LIMIT 5"""))
def stream_live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest aircraft of those tracked at the end of the table, and how many these are."""
    jobs.use_rocksdb(spark)
    path = new_path(spark, "live")
    changes = jobs.stream_live(_feed(spark, messages(spark, sf_dir)), 5, SIX_HOURS, tie=["event_id"], lateness=f"{LATE} seconds")
    jobs.start(changes, jobs.table_sink(path), "update", once=True).awaitTermination()
    live, top = jobs.live_status(spark.read.option("basePath", path).parquet(path), "batch", 5)
    return top.withColumn("live", F.lit(live.first()[0]))


@query(ARCHIVED)
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights archived as they close; the row behind the table closes the last ones."""
    feed = _feed(spark, messages(spark, sf_dir).withColumn("icao", F.col("icao").cast("string")), DAY + 1)
    staging, path, check = (new_path(spark, name) for name in ("staging", "archive", "checkpoint"))
    queries = jobs.stream_archive(
        feed, load_rules(SAVING), staging, path, check, DAY, f"{LATE} seconds", width(spark, sf_dir), once=True, fresh_seconds=SIX_HOURS,
        tie=["event_id"], step_seconds=HOUR,
    )
    for q in queries:
        q.awaitTermination()
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    return read_archive(spark, path).info.select(
        "icao", "flight_id", "zone", "level", "packets", micros("first_packet").alias("first_us"),
        micros("last_update").alias("last_us"), "callsign",
        F.coalesce(F.try_element_at("packet_type", F.lit("3")), F.lit(0)).alias("fixes"),
    )
