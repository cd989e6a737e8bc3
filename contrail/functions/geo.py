"""Geodesy and plane geometry as columns.

Distances are on the WGS-84 ellipsoid. Everything is closed form, so it stays in generated
code: Lambert's formula for distance and the order-3 series of Karney (Algorithms for
geodesics, 2013) for the direct problem.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.fence import computed

# WGS-84 (fixed values).
SEMI_MAJOR_KM = 6378.137
FLATTENING = 1 / 298.257223563
SEMI_MINOR_KM = SEMI_MAJOR_KM * (1 - FLATTENING)


def _square(c: Column) -> Column:
    return c * c


def reduced_latitude(lat: Column) -> Column:
    """Parametric latitude in radians of a geographic latitude in degrees."""
    return F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat)))


def with_distance(
    df: DataFrame, lat1: Column, lon1: Column, lat2: Column, lon2: Column, out: str
) -> DataFrame:
    """Add the ellipsoidal distance in kilometres (Lambert; relative error about 1e-6).

    The steps are fenced off from each other: inside one expression, and more so inside CASE
    branches, shared parts would be computed over and over.
    """
    keep = df.columns
    b1, b2 = F.col("_b1"), F.col("_b2")
    d = computed(df, {
        "_b1": reduced_latitude(lat1),
        "_b2": reduced_latitude(lat2),
        "_turn": F.sin(F.radians(lon2 - lon1) / 2),
    })
    d = computed(d, {
        "_sp": F.sin((b1 + b2) / 2),
        "_sq": F.sin((b2 - b1) / 2),
        "_cc": F.cos(b1) * F.cos(b2) * _square(F.col("_turn")),
    })
    half = _square(F.col("_sq")) + F.col("_cc")
    d = computed(d, {"_half": F.least(half, F.lit(1.0))})
    d = computed(d, {"_sigma": 2 * F.asin(F.sqrt("_half"))})
    sigma, half = F.col("_sigma"), F.col("_half")
    p2, q2 = _square(F.col("_sp")), _square(F.col("_sq"))
    x = (sigma - F.sin(sigma)) * p2 * (1 - q2) / F.nullif(1 - half, F.lit(0.0))
    y = (sigma + F.sin(sigma)) * (1 - p2) * q2 / F.nullif(half, F.lit(0.0))
    km = F.lit(SEMI_MAJOR_KM) * (sigma - F.lit(FLATTENING / 2) * (x + y))
    # No value for x or y means the same point or its antipode.
    ends = F.when(half.isNotNull(), F.lit(SEMI_MAJOR_KM) * sigma)
    return computed(d, {out: F.coalesce(km, ends)}).select(*keep, out)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees, 0 to 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def speed_kmh(distance: Column, seconds: Column) -> Column:
    """Average speed; NULL when no time has passed."""
    return F.try_divide(distance * 3600, seconds)


def with_destination(
    df: DataFrame, lat: str, lon: str, heading: str, km: Column, out_lat: str, out_lon: str
) -> DataFrame:
    """Add the point reached after ``km`` along the geodesic that leaves at ``heading``.

    The steps are separate projections so that each is computed once per row.
    """
    f = FLATTENING
    n = f / (2 - f)
    second_ecc2 = (SEMI_MAJOR_KM**2 - SEMI_MINOR_KM**2) / SEMI_MINOR_KM**2
    keep = df.columns

    def c(name: str) -> Column:
        return F.col(f"_d_{name}")

    def step(frame: DataFrame, **cols: Column) -> DataFrame:
        return frame.withColumns({f"_d_{k}": v for k, v in cols.items()})

    d = step(df, b=reduced_latitude(F.col(lat)), a=F.radians(heading), km=km)
    d = step(
        d,
        s0=F.sin(c("a")) * F.cos(c("b")),
        c0=F.hypot(F.cos(c("a")), F.sin(c("a")) * F.sin(c("b"))),
        x=F.cos(c("a")) * F.cos(c("b")),
        y=F.sin(c("b")),
    )
    d = step(
        d,
        sig1=F.atan2(c("y"), c("x")),
        om1=F.atan2(c("s0") * c("y"), c("x")),
        k2=F.lit(second_ecc2) * _square(c("c0")),
    )
    d = step(d, e=c("k2") / (2 * (1 + F.sqrt(1 + c("k2"))) + c("k2")))
    e = c("e")
    d = step(
        d,
        tau=c("sig1")
        + (-e / 2 + e * e * e * (3 / 16)) * F.sin(2 * c("sig1"))
        - e * e / 16 * F.sin(4 * c("sig1"))
        - e * e * e / 48 * F.sin(6 * c("sig1"))
        + c("km") * (1 - e) / (F.lit(SEMI_MINOR_KM) * (1 + e * e / 4)),
    )
    d = step(
        d,
        sig2=c("tau")
        + (e / 2 - e * e * e * (9 / 32)) * F.sin(2 * c("tau"))
        + e * e * (5 / 16) * F.sin(4 * c("tau"))
        + e * e * e * (29 / 96) * F.sin(6 * c("tau")),
    )
    a3 = 1 - (0.5 - n / 2) * e - (0.25 + n / 8) * e * e
    c31 = (0.25 - n / 4) * e + 0.125 * e * e
    c32 = (1 / 16 - 3 * n / 32) * e * e
    turns = c31 * (F.sin(2 * c("sig2")) - F.sin(2 * c("sig1"))) + c32 * (
        F.sin(4 * c("sig2")) - F.sin(4 * c("sig1"))
    )
    d = step(
        d,
        b2=F.atan2(
            c("c0") * F.sin(c("sig2")), F.hypot(c("c0") * F.cos(c("sig2")), c("s0"))
        ),
        dl=F.atan2(c("s0") * F.sin(c("sig2")), F.cos(c("sig2")))
        - c("om1")
        - F.lit(f) * c("s0") * a3 * (c("sig2") - c("sig1") + turns),
    )
    # The two longitudes on the auxiliary sphere each lie in (-pi, pi]; bring the
    # difference back to one turn before adding it.
    d = d.withColumns({
        out_lat: F.degrees(F.atan(F.tan(c("b2")) / (1 - f))),
        out_lon: F.pmod(F.col(lon) + F.degrees(c("dl")) + 180, F.lit(360.0)) - 180,
    })
    return d.select(*keep, out_lat, out_lon)


# Rings are arrays of edges struct(lat1, lon1, lat2, lon2, ey, ex, inv): the two ends, their
# difference, and one over the squared length (0 for an edge without length). Functions over
# arrays are not compiled, so the lambdas below are kept short and callers test boxes first; the
# edges of a few known rings can be constants instead.
EDGE = "struct<lat1:double,lon1:double,lat2:double,lon2:double,ey:double,ex:double,inv:double>"


def edge(lat1: float, lon1: float, lat2: float, lon2: float) -> dict[str, float]:
    ey, ex = lat2 - lat1, lon2 - lon1
    len2 = ey * ey + ex * ex
    return {
        "lat1": lat1, "lon1": lon1, "lat2": lat2, "lon2": lon2, "ey": ey, "ex": ex,
        "inv": 1 / len2 if len2 > 0 else 0.0,
    }


def edges_of(ring: Column) -> Column:
    """Edges of a ring array column struct(lat, lon); points repeated in a row give none."""
    closed = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def join(a: Column, b: Column) -> Column:
        ey, ex = b["lat"] - a["lat"], b["lon"] - a["lon"]
        return F.struct(
            a["lat"].alias("lat1"), a["lon"].alias("lon1"),
            b["lat"].alias("lat2"), b["lon"].alias("lon2"),
            ey.alias("ey"), ex.alias("ex"),
            F.coalesce(1 / F.nullif(ey * ey + ex * ex, F.lit(0.0)), F.lit(0.0)).alias("inv"),
        )

    return F.filter(F.zip_with(ring, closed, join), lambda e: e["inv"] > 0)


def constants(edges: list[dict[str, float]]) -> list[dict[str, Column]]:
    """Edges (see ``edge``) as constants: tests of these are compiled, a copy of the code for each edge."""
    return [{name: F.lit(value) for name, value in e.items()} for e in edges]


Edge = Column | dict[str, Column]


def side(e: Edge, lat: Column, lon: Column) -> Column:
    return (lat - e["lat1"]) * e["ex"] - (lon - e["lon1"]) * e["ey"]


def crosses(e: Edge, lat: Column, lon: Column) -> Column:
    return ((e["lat1"] > lat) != (e["lat2"] > lat)) & ((side(e, lat, lon) > 0) == (e["ey"] > 0))


def on_ring(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether the position lies on an edge of the ring."""
    return F.exists(
        edges,
        lambda e: (side(e, lat, lon) == 0)
        & lat.between(F.least(e["lat1"], e["lat2"]), F.greatest(e["lat1"], e["lat2"]))
        & lon.between(F.least(e["lon1"], e["lon2"]), F.greatest(e["lon1"], e["lon2"])),
    )


def odd_crossings(edges: list[dict[str, Column]], lat: Column, lon: Column) -> Column:
    """Whether a line from the position to the east meets an odd number of edges."""
    return functools.reduce(lambda a, b: a != b, [crosses(e, lat, lon) for e in edges])


def in_line(edges: list[dict[str, Column]], lat: Column, lon: Column) -> Column:
    """Whether the position lies on the line through any edge; ``on_ring`` needs asking only then."""
    return functools.reduce(lambda a, b: a | b, [side(e, lat, lon) == 0 for e in edges])


def inside_ring(edges: Column, lat: Column, lon: Column) -> Column:
    """Strictly inside the ring: odd number of crossings and not on an edge."""
    odd = F.size(F.filter(edges, lambda e: crosses(e, lat, lon))) % 2 == 1
    return odd & ~on_ring(edges, lat, lon)


def segment_meets_box(
    lat: Column, lon: Column, dy: Column, dx: Column,
    south: Column, north: Column, west: Column, east: Column,
) -> Column:
    """Whether the segment from the point along (dy, dx) can reach the box; errs towards yes."""

    def span(at: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = (low - at) / F.nullif(step, F.lit(0.0)), (high - at) / F.nullif(step, F.lit(0.0))
        never = F.when(at.between(low, high), F.lit(0.0)).otherwise(F.lit(2.0))
        return F.coalesce(F.least(a, b), never), F.coalesce(F.greatest(a, b), F.lit(1.0))

    y0, y1 = span(lat, dy, south, north)
    x0, x1 = span(lon, dx, west, east)
    enters = F.greatest(y0, x0, F.lit(0.0))
    leaves = F.least(y1, x1, F.lit(1.0))
    return enters <= leaves + 1e-9


def crossing(e: Edge, lat: Column, lon: Column, dy: Column, dx: Column) -> Column:
    """Fraction of the straight lat/lon segment at which it meets an edge, if it does."""
    det = dy * e["ex"] - dx * e["ey"]
    gap_y, gap_x = e["lat1"] - lat, e["lon1"] - lon
    t = F.try_divide(gap_y * e["ex"] - gap_x * e["ey"], det)
    u = F.try_divide(gap_y * dx - gap_x * dy, det)
    return F.when(u.between(0.0, 1.0) & t.between(0.0, 1.0), t)


def first_crossing(edges: Column, lat: Column, lon: Column, dy: Column, dx: Column) -> Column:
    """Smallest fraction of the straight lat/lon segment at which it meets the ring."""
    return F.array_min(F.transform(edges, lambda e: crossing(e, lat, lon, dy, dx)))


def gap(e: Edge, lat: Column, lon: Column) -> Column:
    """Squared distance of the position to an edge in the lat/lon plane."""
    gy, gx = lat - e["lat1"], lon - e["lon1"]
    dot = gy * e["ey"] + gx * e["ex"]
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot * e["inv"]))
    return _square(gy - s * e["ey"]) + _square(gx - s * e["ex"])


def nearest_on_ring(edges: Column, lat: Column, lon: Column) -> Column:
    """The edge that comes closest to the position in the lat/lon plane."""
    gaps = F.transform(edges, lambda e: gap(e, lat, lon))
    return F.element_at(edges, F.array_position(gaps, F.array_min(gaps)).cast("int"))


def nearest_on_edge(e: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Point of an edge closest to the position in the lat/lon plane."""
    dot = (lat - e["lat1"]) * e["ey"] + (lon - e["lon1"]) * e["ex"]
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot * e["inv"]))
    return e["lat1"] + s * e["ey"], e["lon1"] + s * e["ex"]
