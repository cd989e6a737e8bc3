"""Positions against geofences: containment, time to enter, distance."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail import schema
from contrail.functions import geo
from contrail.functions.fence import computed
from contrail.operators.rules import Rules, Zone, zone_edges, zone_literal

# Most zone edges put into a plan as one constant; more zones are taken in several parts.
MAX_EDGES = 20_000
# Most zone edges whose tests are compiled one by one; functions over arrays test larger sets.
COMPILED_EDGES = 16
# Most edges of the pieces of zones that are sent to every task; more are shuffled.
BROADCAST_EDGES = 200_000


def zone_parts(zones: Sequence[Zone], max_edges: int = MAX_EDGES) -> list[tuple[Zone, ...]]:
    """Zones in parts of at most ``max_edges`` edges (a larger single zone is its own part)."""
    parts: list[list[Zone]] = [[]]
    size = 0
    for zone in zones:
        if parts[-1] and size + len(zone.ring) > max_edges:
            parts.append([])
            size = 0
        parts[-1].append(zone)
        size += len(zone.ring)
    return [tuple(p) for p in parts]


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def zone_eta(
    positions: DataFrame,
    zones: Sequence[Zone],
    max_time_s: float = schema.MAX_TIME_SECONDS,
    with_distance: bool = False,
    lat: str = "latitude",
    lon: str = "longitude",
    speed: str = "speed",
    heading: str = "heading",
    distance_to: Sequence[str] | None = None,
) -> DataFrame:
    """Every position with every zone: ``inside``, ``eta`` in seconds and ``distance_km``.

    ``distance_to`` names the zones whose distance is wanted, if not all; others get NULL.

    The zones come from the configuration and travel in the plan as a constant, so nothing is
    shuffled or joined. The end of the ray is computed once per position. Bounding boxes are
    tested first; only rows that pass look at edges. Up to ``COMPILED_EDGES`` edges are
    constants in compiled code, more of them are read from arrays.
    """
    ray = geo.with_destination(
        positions, lat, lon, heading, F.lit(float(max_time_s)) * F.col(speed) / 3600,
        "_to_lat", "_to_lon",
    )
    ray = ray.withColumns({"_dy": F.col("_to_lat") - F.col(lat), "_dx": F.col("_to_lon") - F.col(lon)})
    parts = [
        ray.select("*", F.posexplode(zone_literal(part)).alias("_n", "_z"))
        for part in zone_parts(zones)
    ]
    d = functools.reduce(DataFrame.unionByName, parts)
    z = F.col("_z")
    rings = [geo.constants(zone_edges(v)) for v in zones]
    few = 0 < sum(map(len, rings)) <= COMPILED_EDGES

    def of_ring(test: Callable[[list], Column | None], asked: Sequence[int] = range(len(rings))) -> Column:
        """The test of the row's own zone, whose edges are constants."""
        tests = [(i, test(rings[i])) for i in asked]
        return functools.reduce(lambda a, x: a if x[1] is None else a.when(F.col("_n") == x[0], x[1]), tests, F)

    here_lat, here_lon = F.col(lat), F.col(lon)
    in_box = here_lat.between(z["south"], z["north"]) & here_lon.between(z["west"], z["east"])
    dy, dx = F.col("_dy"), F.col("_dx")
    box = (z["south"], z["north"], z["west"], z["east"])
    reaches = geo.segment_meets_box(here_lat, here_lon, dy, dx, *box)
    moving = F.coalesce((F.col(speed) > 0) & F.col(heading).isNotNull(), F.lit(False))
    asked = [i for i, v in enumerate(zones) if with_distance and (distance_to is None or v.name in distance_to)]
    if few:
        # One projection for all tests of edges: Spark compiles it apart from other steps, in short methods, because of its function over arrays.
        most = range(max((len(rings[i]) for i in asked), default=0))
        gap = lambda i: lambda r: geo.gap(r[i], here_lat, here_lon) if i < len(r) else None
        odd = of_ring(lambda r: geo.odd_crossings(r, here_lat, here_lon))
        on_ring = of_ring(lambda r: geo.in_line(r, here_lat, here_lon)) & geo.on_ring(z["edges"], here_lat, here_lon)
        d = d.withColumns({
            "_in": F.when(in_box, odd & ~on_ring).otherwise(F.lit(False)),
            "_meets": F.when(moving & reaches, of_ring(lambda r: _least([geo.crossing(e, here_lat, here_lon, dy, dx) for e in r]))),
            **{f"_gap{i}": of_ring(gap(i), asked) for i in most},
        })
        d = computed(d, {"inside": F.col("_in"), "_t": F.when(~F.col("_in"), F.col("_meets"))})
    else:
        d = computed(d, {
            "inside": F.when(in_box, geo.inside_ring(z["edges"], here_lat, here_lon)).otherwise(F.lit(False)),
            "_reaches": moving & reaches,
        })
        crossing = geo.first_crossing(z["edges"], here_lat, here_lon, dy, dx)
        d = computed(d, {"_t": F.when(~F.col("inside") & F.col("_reaches"), crossing)})
    d = geo.with_distance(
        d, here_lat, here_lon, here_lat + F.col("_t") * dy, here_lon + F.col("_t") * dx, "_ahead"
    )
    eta = (
        F.when(F.col("inside"), F.lit(0.0))
        .when(F.col("_t").isNotNull(), F.col("_ahead") / F.col(speed) * 3600)
        .otherwise(F.lit(math.inf))
    )
    cols = [z["zone"].alias("zone"), F.col("inside"), eta.alias("eta")]
    if with_distance:
        wanted = F.lit(True) if distance_to is None else z["zone"].isin(*distance_to)
        if few and asked:
            d = computed(d, {"_least": _least([F.col(f"_gap{i}") for i in most])})
            first = functools.reduce(lambda a, i: a.when(F.col(f"_gap{i}") == F.col("_least"), i), most, F)
            near = F.get(z["edges"], first)
        else:
            near = geo.nearest_on_ring(z["edges"], here_lat, here_lon)
        d = computed(d, {"_near": F.when(~F.col("inside") & wanted, near)})
        d = geo.with_distance(
            d, here_lat, here_lon, *geo.nearest_on_edge(F.col("_near"), here_lat, here_lon), "_gap"
        )
        gap = F.when(F.col("inside"), F.lit(0.0)).otherwise(F.col("_gap"))
        cols.append(F.when(wanted, gap).alias("distance_km"))
    return d.select(*positions.columns, *cols)


def rule_states(
    states: DataFrame, rules: Rules, max_time_s: float = schema.MAX_TIME_SECONDS,
    distance_to: Sequence[str] | None = None,
) -> DataFrame:
    """``zone_eta`` with what the rules need; datums that were never seen become NULL."""
    d = zone_eta(states, rules.zones, max_time_s, rules.uses_distance, distance_to=distance_to)
    missing = [
        c for c in (*schema.RULE_COLUMN.values(), "callsign") if c not in d.columns
    ]
    return d.withColumns({
        c: F.lit(None).cast("string" if c == "callsign" else "double") for c in missing
    })


def fit_broadcast(pieces: DataFrame, edges: Column) -> bool:
    """Whether ``pieces``, each with so many ``edges``, are few enough to be broadcast.

    Sizes of files and plans say little of it: compressed files and exploded rows are many times larger in the driver's memory.
    """
    return (pieces.agg(F.sum(edges)).first()[0] or 0) <= BROADCAST_EDGES


def containing_zones(
    positions: DataFrame,
    zones: DataFrame,
    cell_degrees: float = 0.25,
    spread: int = 16,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Positions joined to the zones that strictly contain them, for any number of zones.

    Both sides are cut into grid cells and meet in an equi-join. Up to ``BROADCAST_EDGES`` edges of
    zone pieces are broadcast. More are shuffled; a cell over a busy airport may hold a large share
    of all positions, so positions are spread over ``spread`` buckets per cell then and the far
    smaller zone pieces are repeated once per bucket.
    """
    size = F.lit(float(cell_degrees))
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    def cells(values: Column) -> Column:
        return F.sequence(F.floor(F.array_min(values) / size), F.floor(F.array_max(values) / size))

    pieces = (
        zones.filter(F.size("ring") >= 3)
        .withColumn("_edges", geo.edges_of(F.col("ring")))
        .withColumn("_cy", F.explode(cells(lats)))
        .withColumn("_cx", F.explode(cells(lons)))
        .select("zone", "_edges", "_cy", "_cx")
    )
    placed = positions.withColumns({"_cy": F.floor(F.col(lat) / size), "_cx": F.floor(F.col(lon) / size)})
    cell = ["_cy", "_cx"]
    if fit_broadcast(pieces, F.size("_edges")):
        pieces = F.broadcast(pieces)
    else:
        pieces = pieces.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).hint("merge")
        placed = placed.withColumn("_bucket", F.pmod(F.xxhash64(*positions.columns), F.lit(spread)).cast("int"))
        cell.append("_bucket")
    return (
        placed.join(pieces, cell)
        .filter(geo.inside_ring(F.col("_edges"), F.col(lat), F.col(lon)))
        .select(*positions.columns, "zone")
    )
