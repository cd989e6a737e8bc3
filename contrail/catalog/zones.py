"""Registered queries: geodesy, containment, time to enter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail import schema
from contrail.catalog.base import POS, bearing_sql, km_sql, positions, table, with_
from contrail.functions import geo
from contrail.operators.rules import Zone, load_rules
from contrail.operators.ray_grid import zone_eta_by_grid
from contrail.operators.zones import containing_zones, zone_eta

# Three convex zones, one concave, one of the degenerate kind.
RINGS = {
    "square": [[35.2, -78.8], [35.2, -78.4], [35.6, -78.4], [35.6, -78.8]],
    "diamond": [[35.9, -78.2], [36.1, -78.0], [35.9, -77.8], [35.7, -78.0]],
    "wedge": [[35.05, -78.95], [35.15, -78.55], [35.12, -78.95]],
    "point": [[35.5, -78.5], [35.5, -78.5], [35.5, -78.5]],
}
CONCAVE = [[35.1, -78.9], [35.1, -78.1], [35.9, -78.1], [35.9, -78.3], [35.3, -78.5], [35.9, -78.9]]

_SAVE = {"telemetry": {"default": "all"}, "calculated": {"default": "all"}}
CONFIG = {
    "components": {
        "soon": {"eta": {"maximum": 1800}},
        "fast": {"horizontal_speed": {"minimum": 500}},
        "within": {"distance": {"maximum": 20}},
    },
    "categories": {
        "quiet": {"alert_method": "print", "save": _SAVE},
        "loud": {"alert_method": "kafka", "arguments": {"server": "localhost:9092"}, "save": _SAVE},
    },
    "zones": {
        "square": {
            "coordinates": RINGS["square"],
            "levels": {
                "warn": {"category": "quiet", "requirements": "soon", "seconds": 60},
                "alert": {"category": "loud", "requirements": "soon and fast", "seconds": 30},
            },
        },
        "diamond": {
            "coordinates": RINGS["diamond"],
            "levels": {
                "warn": {"category": "quiet", "requirements": "within or not fast", "seconds": 60}
            },
        },
        "wedge": {
            "coordinates": RINGS["wedge"],
            "levels": {
                "watch": {
                    "category": {"alert_method": "kafka", "save": _SAVE},
                    "requirements": "soon",
                    "seconds": 2,
                }
            },
        },
        "point": {"coordinates": RINGS["point"], "levels": {}},
    },
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def edges_sql(rings: dict[str, list]) -> str:
    rows = []
    for name, ring in rings.items():
        for a, b in zip(ring, ring[1:] + ring[:1]):
            rows.append(f"('{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})")
    return (
        "e AS (SELECT zone, a::DOUBLE AS y1, b::DOUBLE AS x1, c::DOUBLE AS y2, d::DOUBLE AS x2 "
        f"FROM (VALUES {', '.join(rows)}) AS t(zone, a, b, c, d))"
    )


def destination_sql(source: str, max_time_s: float) -> list[str]:
    """End point after ``max_time_s``: the iterated direct formula, one CTE per step."""
    a, b = geo.SEMI_MAJOR_KM, geo.SEMI_MINOR_KM
    f = geo.FLATTENING
    ctes = [
        f"""d0 AS MATERIALIZED (SELECT *, {max_time_s}::DOUBLE * speed / 3600 AS km,
          atan((1 - {f!r}::DOUBLE) * tan(radians(latitude))) AS u1, radians(heading) AS az
          FROM {source})""",
        """d1 AS MATERIALIZED (SELECT *, atan2(tan(u1), cos(az)) AS s1, cos(u1) * sin(az) AS sa FROM d0)""",
        f"""d2 AS MATERIALIZED (SELECT *, (1 - sa * sa) * {(a * a - b * b) / (b * b)!r}::DOUBLE AS uu FROM d1)""",
        """d3 AS MATERIALIZED (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa,
          uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM d2)""",
        f"""i0 AS MATERIALIZED (SELECT *, km / ({b!r}::DOUBLE * aa) AS sg FROM d3)""",
    ]
    last = 8
    for i in range(1, last + 1):
        ctes.append(f"""i{i} AS MATERIALIZED (SELECT * REPLACE ({f"km / ({b!r}::DOUBLE * aa)"} + bb * sin(sg) *
          (cos(2 * s1 + sg) + bb / 4 * (cos(sg) * (-1 + 2 * pow(cos(2 * s1 + sg), 2))
          - bb / 6 * cos(2 * s1 + sg) * (-3 + 4 * pow(sin(sg), 2))
          * (-3 + 4 * pow(cos(2 * s1 + sg), 2)))) AS sg) FROM i{i - 1})""")
    ctes.append(f"""d5 AS MATERIALIZED (SELECT *, atan2(sin(u1) * cos(sg) + cos(u1) * sin(sg) * cos(az),
        (1 - {f!r}::DOUBLE) * sqrt(sa * sa + pow(sin(u1) * sin(sg) - cos(u1) * cos(sg) * cos(az), 2)))
          AS phi,
        atan2(sin(sg) * sin(az), cos(u1) * cos(sg) - sin(u1) * sin(sg) * cos(az)) AS lam,
        {f!r}::DOUBLE / 16 * (1 - sa * sa) * (4 + {f!r}::DOUBLE * (4 - 3 * (1 - sa * sa))) AS cc
        FROM i{last})""")
    # Longitudes of end points lie between -180 and 180, as geodesic libraries give them.
    ctes.append(f"""r AS MATERIALIZED (SELECT * EXCLUDE (km, u1, az, s1, sa, uu, aa, bb, sg, phi, lam, cc, far_lon),
        CASE WHEN abs(far_lon) > 180 THEN (far_lon + 540) % 360 - 180 ELSE far_lon END AS to_lon
        FROM (SELECT *, degrees(phi) AS to_lat,
        longitude + degrees(lam - (1 - cc) * {f!r}::DOUBLE * sa * (sg + cc * sin(sg) *
          (cos(2 * s1 + sg) + cc * cos(sg) * (-1 + 2 * pow(cos(2 * s1 + sg), 2))))) AS far_lon
        FROM d5))""")
    return ctes


def eta_sql(source: str, max_time_s: float, rings: dict[str, list], edges: str = "") -> list[str]:
    """Every row of ``source`` with every zone: half-plane tests and edge hits."""
    return [
        *destination_sql(source, max_time_s),
        edges or edges_sql(rings),
        """w AS MATERIALIZED (SELECT r.*, e.*,
            (y2 - y1) * (longitude - x1) - (x2 - x1) * (latitude - y1) AS side,
            (to_lat - latitude) * (x2 - x1) - (to_lon - longitude) * (y2 - y1) AS det,
            ((y1 - latitude) * (x2 - x1) - (x1 - longitude) * (y2 - y1)) AS tn,
            ((y1 - latitude) * (to_lon - longitude) - (x1 - longitude) * (to_lat - latitude)) AS un,
            greatest(0.0, least(1.0, CASE WHEN y1 = y2 AND x1 = x2 THEN 0.0 ELSE
              ((latitude - y1) * (y2 - y1) + (longitude - x1) * (x2 - x1))
              / (pow(y2 - y1, 2) + pow(x2 - x1, 2)) END)) AS s
          FROM r CROSS JOIN e)""",
        """y AS MATERIALIZED (SELECT event_id, zone, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
            any_value(speed) AS speed, any_value(to_lat) AS to_lat, any_value(to_lon) AS to_lon,
            bool_and(side > 0) OR bool_and(side < 0) AS inside,
            min(CASE WHEN det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1
                THEN tn / det END) AS t,
            arg_min({'y': y1 + s * (y2 - y1), 'x': x1 + s * (x2 - x1)},
              pow(latitude - y1 - s * (y2 - y1), 2) + pow(longitude - x1 - s * (x2 - x1), 2)) AS near
          FROM w GROUP BY event_id, zone)""",
        f"""zz AS MATERIALIZED (SELECT event_id, zone, inside,
            CASE WHEN inside THEN 0.0 WHEN t IS NULL THEN 'inf'::DOUBLE ELSE
              {km_sql('latitude', 'longitude', '(latitude + t * (to_lat - latitude))',
                      '(longitude + t * (to_lon - longitude))')} / speed * 3600 END AS eta,
            CASE WHEN inside THEN 0.0 ELSE
              {km_sql('latitude', 'longitude', 'near.y', 'near.x')} END AS distance_km FROM y)""",
        f"z AS (SELECT zz.*, o.* EXCLUDE (event_id) FROM zz JOIN {source} o USING (event_id))",
    ]


# With the concave zone left out the half-plane test is exact.
_MAX = schema.MAX_TIME_SECONDS
ETA = [POS, *eta_sql("p", _MAX, RINGS)]
STATE_ETA = eta_sql("states", _MAX, RINGS)


def _zones() -> tuple[Zone, ...]:
    return load_rules(CONFIG).zones


@query(with_(POS, select=f"""
    , q AS (SELECT *, lag(latitude) OVER (ORDER BY event_id) AS la, lag(longitude) OVER (ORDER BY event_id) AS lo
            FROM p)
    SELECT event_id,
      round({km_sql('latitude', 'longitude', '36.6810752::DOUBLE', '(-78.8758528)::DOUBLE')}, 4) AS home_km,
      round({bearing_sql('latitude', 'longitude', '36.6810752::DOUBLE', '(-78.8758528)::DOUBLE')}, 4) AS home_bearing
    FROM p"""))
def distance_and_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing from every position to the receiver."""
    p = positions(spark, sf_dir)
    home = [F.lit(v) for v in schema.HOME]
    here = [F.col("latitude"), F.col("longitude")]
    return geo.with_distance(p, *here, *home, "km").select(
        "event_id",
        F.round("km", 4).alias("home_km"),
        F.round(geo.bearing(*here, *home), 4).alias("home_bearing"),
    )


@query(with_(POS, *destination_sql("p", 3600), select="""
    SELECT event_id, round(to_lat, 4) AS to_lat, round(to_lon, 4) AS to_lon FROM r"""))
def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every aircraft will be in an hour."""
    d = geo.with_destination(
        positions(spark, sf_dir), "latitude", "longitude", "heading", F.col("speed"),
        "to_lat", "to_lon",
    )
    return d.select("event_id", F.round("to_lat", 4).alias("to_lat"), F.round("to_lon", 4).alias("to_lon"))


@query(with_(*ETA, select="""
    SELECT event_id, zone, inside, CASE WHEN isinf(eta) THEN -1.0 ELSE round(eta, 3) END AS eta,
      round(distance_km, 4) AS distance_km FROM z"""))
def zone_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position with every zone: containment, time to enter, distance."""
    z = zone_eta(positions(spark, sf_dir), _zones(), with_distance=True)
    eta = F.when(F.abs("eta") < float("inf"), F.round("eta", 3)).otherwise(-1.0)
    return z.select(
        "event_id", "zone", "inside", eta.alias("eta"), F.round("distance_km", 4).alias("distance_km")
    )


@query(with_(*ETA, select="""
    SELECT zone, count(*) FILTER (WHERE inside) AS inside, count(*) FILTER (WHERE isinf(eta)) AS never,
      round(min(eta) FILTER (WHERE eta > 0 AND NOT isinf(eta)), 3) AS soonest FROM z GROUP BY zone"""))
def zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zone_eta(positions(spark, sf_dir), _zones())
    finite = F.col("eta") < float("inf")
    return z.groupBy("zone").agg(
        F.count_if("inside").alias("inside"),
        F.count_if(~finite).alias("never"),
        F.round(F.min(F.when((F.col("eta") > 0) & finite, F.col("eta"))), 3).alias("soonest"),
    )


def _winding_sql() -> str:
    """Winding number around every position, exact for the concave ring too."""
    rings = {**RINGS, "notch": CONCAVE}
    return with_(POS, edges_sql(rings), select="""
    SELECT event_id, zone FROM p CROSS JOIN e
    GROUP BY event_id, zone
    HAVING sum(CASE
      WHEN y1 <= latitude AND y2 > latitude
        AND (x2 - x1) * (latitude - y1) - (longitude - x1) * (y2 - y1) > 0 THEN 1
      WHEN y1 > latitude AND y2 <= latitude
        AND (x2 - x1) * (latitude - y1) - (longitude - x1) * (y2 - y1) < 0 THEN -1
      ELSE 0 END) <> 0""")


@query(_winding_sql())
def zones_by_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment through a grid-cell join, as used for many zones."""
    rings = {**RINGS, "notch": CONCAVE}
    zones = spark.createDataFrame(
        [(n, [tuple(p) for p in ring]) for n, ring in rings.items()],
        "zone string, ring array<struct<lat:double,lon:double>>",
    )
    return containing_zones(positions(spark, sf_dir), zones, 0.1).select("event_id", "zone")


# A kite around a place of its own for every supplier.
_KITES = """k AS (SELECT 'S' || s_suppkey AS zone, 35.0::DOUBLE + CAST(s_suppkey * 37 % 997 AS DOUBLE) / 997 AS y,
    -79.0::DOUBLE + CAST(s_suppkey * 53 % 991 AS DOUBLE) / 991 AS x, CAST(1 + s_suppkey % 5 AS DOUBLE) / 64 AS h FROM supplier)"""
_KITE_EDGES = """e AS (SELECT zone, y - h AS y1, x AS x1, y AS y2, x + h AS x2 FROM k
    UNION ALL SELECT zone, y, x + h, y + 2 * h, x FROM k UNION ALL SELECT zone, y + 2 * h, x, y, x - h FROM k
    UNION ALL SELECT zone, y, x - h, y - h, x FROM k)"""


def kites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    y, x = F.lit(35.0) + (n * 37 % 997).cast("double") / 997, F.lit(-79.0) + (n * 53 % 991).cast("double") / 991
    h = (1 + n % 5).cast("double") / 64
    corners = [(y - h, x), (y, x + h), (y + 2 * h, x), (y, x - h)]
    ring = F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in corners])
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), n.cast("string")).alias("zone"), ring.alias("ring"))


@query(with_(POS, _KITES, *eta_sql("p", _MAX, {}, _KITE_EDGES), select="""
    SELECT event_id, zone, inside, round(eta, 3) AS eta FROM z WHERE NOT isinf(eta)"""))
def zone_times_by_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with the zones they are in or enter, for zones that are a table."""
    z = zone_eta_by_grid(positions(spark, sf_dir), kites(spark, sf_dir), cell_degrees=0.1)
    return z.select("event_id", "zone", "inside", F.round("eta", 3).alias("eta"))
