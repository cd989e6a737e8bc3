"""Registered queries: frames, validity, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail import schema
from contrail.catalog.base import table, us, width, with_
from contrail.catalog.encode import frames
from contrail.operators.frames import adsb_only, decode_messages, valid_frames, with_fields
from contrail.plans.live import messages_from_frames
from contrail.sources.frames import frames_from_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


N = """n AS (SELECT event_id, epoch_us(ts) AS us, event_id % 8 AS kind, event_id // 8 % 2 AS odd,
    event_id // 8 % 4 AS turn,
    format('{:06X}', (user_id * 48271 + 4194304) % 16777215 + 1) AS icao,
    CAST(event_id * 7919 % 131072 AS DOUBLE) / 131072 AS y,
    CAST(event_id * 104729 % 131072 AS DOUBLE) / 131072 AS x,
    CASE WHEN event_id // 8 % 2 = 1 THEN 4 ELSE 1 END AS scale,
    event_id * 3 % 1024 AS va, event_id * 7 % 1024 AS vb, event_id % 400 AS vr,
    event_id * 5 % 128 AS mov FROM events)"""
_LAT, _LON = (f"({v!r}::DOUBLE)" for v in schema.HOME)


def _near(ref: str, zone: str, part: str) -> str:
    inside = f"((({ref} % {zone}) + {zone}) % {zone}) / {zone}"
    return f"({zone} * (floor({ref} / {zone}) + floor(0.5 + {inside} - {part}) + {part}))"


_NL = "floor(2 * pi() / acos(1 - (1 - cos(pi() / 30)) / pow(cos(radians(latitude)), 2)))"
CPR = f"""c AS (SELECT *, {_near('longitude_ref', 'zone', 'x')} AS longitude FROM (
    SELECT *, {_LON} AS longitude_ref, span / greatest({_NL} - odd, 1) AS zone FROM (
      SELECT *, {_near(_LAT, '(span / (60 - odd))', 'y')} AS latitude FROM (
        SELECT *, CASE WHEN kind = 5 THEN 90.0::DOUBLE ELSE 360.0::DOUBLE END AS span FROM n))))"""


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_messages(with_fields(frames(spark, sf_dir)), keep=["event_id"])


@query("""
    SELECT event_id, format('{:014X}', event_id) AS hex FROM events
    UNION ALL SELECT event_id, format('{:014X}', event_id * 3) FROM events""")
def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver text with several lines per value, marks and empty lines."""
    e = table(spark, sf_dir, "events")
    one, two = (F.lpad(F.hex(F.col("event_id") * k), 14, "0") for k in (1, 3))
    text = F.concat(F.lit("*"), one, F.lit(";\n\n*"), two, F.lit(";\r\n"))
    found = frames_from_lines(e.select(text.alias("value"), "event_id"), "main", "value", "event_id")
    return found.select(F.col("ts").alias("event_id"), "hex")


@query(with_(N, select="""
    SELECT event_id, icao, CASE WHEN kind < 6 THEN 17 WHEN kind = 6 THEN 11 WHEN turn = 0 THEN 4
      WHEN turn = 1 THEN 20 ELSE 17 END AS df
    FROM n WHERE NOT (kind = 7 AND turn = 3)"""))
def valid_frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = valid_frames(frames(spark, sf_dir))
    return ok.select("event_id", "icao", "df")


@query(with_(N, select="""
    SELECT event_id, kind = 7 AND turn = 3 AS damaged FROM n WHERE kind < 6 OR kind = 7 AND turn > 1"""))
def adsb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = adsb_only(frames(spark, sf_dir))
    return kept.select("event_id", (F.col("crc") != 0).alias("damaged"))


@query(with_(N, select="""
    SELECT event_id, icao, 'AB' || format('{:04d}', event_id % 10000) AS callsign,
      1 + event_id % 4 AS cat_tc, event_id % 7 AS cat_ca
    FROM n WHERE kind = 0 OR (kind = 7 AND turn = 3)"""))
def decode_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded(spark, sf_dir).filter("type_cat = 1")
    return d.select(
        "event_id", "icao", "callsign", F.col("cat_tc").cast("bigint").alias("cat_tc"),
        F.col("cat_ca").cast("bigint").alias("cat_ca"),
    )


@query(with_(N, CPR, select="""
    SELECT event_id, icao, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      round((event_id * 13 % 2048 * 25 - 1000) * 0.3048, 3) AS altitude FROM c
    WHERE kind = 1 """))
def decode_barometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded(spark, sf_dir).filter("type_cat = 3")
    return d.select(
        "event_id", "icao", F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"), F.round("altitude", 3).alias("altitude"),
    )


SQL["decode_barometric"] = SQL["decode_barometric"].replace("0.3048", "0.3048::DOUBLE")


@query(with_(N, CPR, select="""
    SELECT event_id, icao, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      round(event_id * 17 % 4096 * 3.28084::DOUBLE * 0.3048::DOUBLE, 3) AS altitude FROM c
    WHERE kind = 2 AND event_id * 17 % 4096 <> 0"""))
def decode_gnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded(spark, sf_dir).filter("type_cat = 4")
    return d.select(
        "event_id", "icao", F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"), F.round("altitude", 3).alias("altitude"),
    )


VEL = """v AS (SELECT event_id, icao, vr, va, vb, kind,
    CASE WHEN kind = 3 THEN sqrt(ew * ew + ns * ns) ELSE (vb - 1) * scale END AS knots,
    CASE WHEN kind = 3 THEN (degrees(atan2(ew, ns)) + 360) % 360
         WHEN event_id % 11 > 0 THEN va * 360.0::DOUBLE / 1024 END AS direction
  FROM (SELECT *, CAST((va - 1) * scale * (CASE event_id % 3 % 2 WHEN 1 THEN -1 ELSE 1 END) AS DOUBLE) AS ew,
      CAST((vb - 1) * scale * (CASE event_id % 5 % 2 WHEN 1 THEN -1 ELSE 1 END) AS DOUBLE) AS ns
    FROM n WHERE kind IN (3, 4)))"""


@query(with_(N, VEL, select="""
    SELECT event_id, icao, round(knots * 1.852::DOUBLE, 3) AS horizontal_speed,
      round(direction, 3) AS direction,
      round((vr - 1) * 64 * (CASE event_id % 2 WHEN 1 THEN -1 ELSE 1 END) * 0.00508::DOUBLE, 3)
        AS vertical_speed
    FROM v WHERE va <> 0 AND vb <> 0 AND vr <> 0 AND direction IS NOT NULL"""))
def decode_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground speed and airspeed; rows with a missing field are dropped whole."""
    d = _decoded(spark, sf_dir).filter("type_cat = 5")
    cols = ("horizontal_speed", "direction", "vertical_speed")
    return d.select("event_id", "icao", *[F.round(c, 3).alias(c) for c in cols])


@query(with_(N, VEL, select="""
    SELECT event_id, CASE WHEN va <> 0 AND vb <> 0 THEN round(knots * 1.852::DOUBLE, 3) END AS horizontal_speed,
      CASE WHEN va <> 0 AND vb <> 0 THEN round(direction, 3) END AS direction FROM v"""))
def decode_partial_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_messages(with_fields(frames(spark, sf_dir)), keep_partial=True, keep=["event_id"])
    return d.filter("type_cat = 5").select(
        "event_id", F.round("horizontal_speed", 3).alias("horizontal_speed"),
        F.round("direction", 3).alias("direction"),
    )


SURFACE_SPEED = """1.852::DOUBLE * CASE WHEN mov = 1 THEN 0 WHEN mov < 9 THEN (mov - 1) * 0.125::DOUBLE
        WHEN mov < 13 THEN 1 + (mov - 9) * 0.25::DOUBLE WHEN mov < 39 THEN 2 + (mov - 13) * 0.5::DOUBLE
        WHEN mov < 94 THEN mov - 24 WHEN mov < 109 THEN 70 + (mov - 94) * 2
        WHEN mov < 124 THEN 100 + (mov - 109) * 5 ELSE 175 END"""


@query(with_(N, CPR, select=f"""
    SELECT event_id, icao, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      round({SURFACE_SPEED}, 3) AS horizontal_speed,
      event_id * 11 % 128 * 2.8125::DOUBLE AS direction
    FROM c WHERE kind = 5 AND mov BETWEEN 1 AND 124 AND event_id % 13 > 0"""))
def decode_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded(spark, sf_dir).filter("type_cat = 2")
    return d.select(
        "event_id", "icao", F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"),
        F.round("horizontal_speed", 3).alias("horizontal_speed"), "direction",
    )


@query(with_(N, select="""
    SELECT event_id, icao FROM n WHERE kind = 6 OR (kind = 7 AND turn IN (0, 1))"""))
def decode_sign_of_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other downlink formats; the address of a reply comes out of its parity."""
    return _decoded(spark, sf_dir).filter("type_cat = 0").select("event_id", "icao")


# The category of every frame that is decoded; a missing field drops the frame.
TYPES = """t AS (
  SELECT event_id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 0
      ELSE CASE turn WHEN 3 THEN 1 ELSE 0 END END AS type_cat
  FROM n WHERE kind IN (0, 1, 6) OR (kind = 2 AND event_id * 17 % 4096 <> 0) OR (kind = 7 AND turn <> 2)
    OR (kind = 5 AND mov BETWEEN 1 AND 124 AND event_id % 13 > 0)
  UNION ALL SELECT event_id, 5 FROM v WHERE va <> 0 AND vb <> 0 AND vr <> 0 AND direction IS NOT NULL)"""


@query(with_(N, VEL, TYPES, select="SELECT type_cat, count(*) AS n FROM t GROUP BY ALL"))
def type_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per category."""
    return _decoded(spark, sf_dir).groupBy("type_cat").agg(F.count(F.lit(1)).alias("n"))


@query(with_(N, VEL, TYPES, select="""
    SELECT icao, us, type_cat, count(*) AS n FROM t JOIN n USING (event_id) GROUP BY ALL"""))
def merged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two receivers hear every frame two seconds apart; repeats are merged, then decoded."""
    f = frames(spark, sf_dir).drop("event_id")
    late = f.withColumns({
        "receiver": F.lit("second"), "ts": F.col("ts") + F.expr("INTERVAL 2 SECONDS")
    })
    m = messages_from_frames(f.unionByName(late), slice_seconds=width(spark, sf_dir))
    return m.groupBy("icao", us("ts").alias("us"), "type_cat").agg(F.count(F.lit(1)).alias("n"))


@query(with_(N, select="""
    SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind < 6 OR kind = 7 AND turn = 2) AS intact FROM n
    GROUP BY ALL"""))
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC remainder of intact frames is 0; one flipped bit is always noticed."""
    f = frames(spark, sf_dir)
    at = (F.col("event_id") % 26).cast("int") + 1
    digit = F.conv(F.substring("hex", at, F.lit(1)), 16, 10).cast("int").bitwiseXOR(1)
    flipped = F.overlay("hex", F.hex(digit), at)
    both = with_fields(f).select("event_id", "hex", F.col("crc").alias("before"))
    after = with_fields(both.withColumn("hex", F.when(F.length("hex") == 28, flipped).otherwise(F.col("hex"))))
    ok = (F.length("hex") == 28) & (F.col("before") == 0) & (F.col("crc") != 0)
    return after.groupBy((F.col("event_id") % 8).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("intact")
    )


# Long division of the whole frame by the generator polynomial, one bit after another.
@query("""
    WITH f AS (SELECT event_id, upper(md5(event_id::VARCHAR))[1:CASE WHEN event_id % 3 = 0 THEN 14 ELSE 28 END] AS hex FROM events),
    b AS (SELECT event_id, hex, flatten([[v >> 3 & 1, v >> 2 & 1, v >> 1 & 1, v & 1]
      FOR v IN [instr('123456789ABCDEF', d) FOR d IN string_split(hex, '')]]) AS bits FROM f)
    SELECT event_id, hex, list_reduce([x::BIGINT FOR x IN bits], lambda r, x:
      CASE WHEN (r << 1 | x) >= 16777216 THEN xor(r << 1 | x, 33551369) ELSE r << 1 | x END, 0::BIGINT) AS remainder FROM b""")
def frame_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of arbitrary frames; nothing of the engine made them."""
    digest = F.upper(F.md5(F.col("event_id").cast("string").cast("binary")))
    size = F.when(F.col("event_id") % 3 == 0, 14).otherwise(28)
    rows = table(spark, sf_dir, "events").select("event_id", F.substring(digest, F.lit(1), size).alias("hex"))
    return with_fields(rows).select("event_id", "hex", F.col("crc").cast("long").alias("remainder"))
