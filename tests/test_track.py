import math
import random

import pytest
from helpers import epoch, frame
from pyspark.sql import functions as F

from contrail.operators import qualify as ql
from contrail.operators import track
from contrail.operators.slices import Slices, fit_slice_seconds, fit_slices, slice_id

FIXED = [1.0, 7.0, 100.0, 86400.0]
WIDTHS = [*FIXED, Slices("k", 86400.0, (("a", 2.0),))]


def walk(seed, n=120):
    rng, rows, t = random.Random(seed), [], 0.0
    for i in range(n):
        t += rng.choice([0.5, 1.0, 2.0, 5.0])
        kind = rng.random()
        lat = lon = speed = head = None
        if kind < 0.6:
            lat, lon = 35 + rng.randrange(4) / 100, -79 + rng.randrange(3) / 100
        elif kind < 0.8:
            speed, head = 100.0 + i, float(i % 360)
        rows.append((f"p{seed % 3}", t, i, lat, lon, speed, head))
    return rows


COLS = "icao string, ts double, n int, latitude double, longitude double, horizontal_speed double, direction double"


def brute_motion(rows, back_n, fresh):
    """(n, fix, back fix, speed source, heading source) after every message."""
    out, state = [], {}
    for icao, t, n, lat, lon, speed, head in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.setdefault(icao, {"fixes": [], "speed": None, "head": None})
        if lat is not None and (not s["fixes"] or s["fixes"][-1][1:] != (lat, lon)):
            s["fixes"].append((t, lat, lon))
        if speed is not None:
            s["speed"], s["head"] = (t, speed), (t, head)
        f = s["fixes"]
        if len(f) < 2:
            continue
        back = f[len(f) - back_n] if len(f) >= back_n else f[0]
        use = s["speed"] is not None and f[-1][0] - s["speed"][0] < fresh
        out.append((icao, n, f[-1], back, s["speed"] if use else None, s["head"][1] if use else None))
    return out


@pytest.mark.parametrize("width", [*FIXED, Slices("icao", 86400.0, (("p0", 1.0), ("p1", 7.0)))])
def test_motion_matches_sequential(spark, width):
    rows = [r for seed in (3, 4, 5) for r in walk(seed)]
    got = track.motion(frame(spark, rows, COLS), 4, 6, "icao", "ts", ["n"], width)
    got = {(r.icao, r.n): r for r in epoch(got, "position_ts", "speed_ts").collect()}
    want = brute_motion(rows, 4, 6)
    assert len(got) == len(want)
    for icao, n, fix, back, speed, head in want:
        r = got[icao, n]
        assert (r.latitude, r.longitude) == fix[1:]
        assert r.position_ts == pytest.approx(fix[0], abs=1e-5)
        if speed:
            assert (r.speed, r.heading) == (speed[1], head)
            assert r.speed_ts == pytest.approx(speed[0], abs=1e-5)
        else:
            dy, dx = fix[1] - back[1], (fix[2] - back[2]) * math.cos(math.radians(35))
            flat = math.hypot(dy * 110.94, dx * 111.4) / (fix[0] - back[0]) * 3600
            assert r.speed == pytest.approx(flat, rel=0.02, abs=1e-6)
            assert r.speed_ts == pytest.approx(fix[0], abs=1e-5)


def test_two_fixes_at_one_time_give_no_speed(spark):
    rows = [("a", 1.0, 0, 35.0, -79.0, None, None), ("a", 1.0, 1, 35.1, -79.0, None, None)]
    (r,) = track.motion(frame(spark, rows, COLS), tie=["n"]).collect()
    assert r.speed is None and r.heading == pytest.approx(0)


@pytest.mark.parametrize("width", WIDTHS)
def test_flight_gap_edges(spark, width):
    rows = [("a", t) for t in (0.0, 30.0, 61.0, 62.0)]
    got = track.flights(frame(spark, rows, "k string, ts double"), "k", "ts", 30, width)
    starts = {r.ts: r.flight_start for r in epoch(got, "ts", "flight_start").collect()}
    assert starts == {0.0: 0.0, 30.0: 0.0, 61.0: 61.0, 62.0: 61.0}
    bounds = track.flight_bounds(frame(spark, rows, "k string, ts double"), "k", "ts", 30)
    assert sorted(r.packets for r in bounds.collect()) == [2, 2]


@pytest.mark.parametrize("width", WIDTHS)
def test_asof_nearest_ties_and_repeats(spark, width):
    right = [("a", 0.0, 1, 1.0), ("a", 10.0, 2, 2.0), ("a", 10.0, 3, 3.0), ("a", 20.0, 4, None), ("a", 40.0, 5, 5.0)]
    left = [("a", t, i) for i, t in enumerate((-5.0, 5.0, 10.0, 24.0, 25.0, 99.0))] + [("b", 1.0, 9)]
    got = track.asof_nearest(
        frame(spark, left, "k string, ts double, i int"),
        frame(spark, right, "k string, ts double, n int, v double"),
        "k", "ts", ["v"], ["n"], width,
    )
    assert {r.i: r.v for r in got.collect()} == {0: 1.0, 1: 3.0, 2: 3.0, 3: 3.0, 4: 5.0, 5: 5.0, 9: None}


@pytest.mark.parametrize("width", WIDTHS)
def test_repeats_and_changed_pairs(spark, width):
    rows = [("a", float(t), v) for t, v in enumerate((1.0, 1.0, 2.0, None, 2.0, 1.0))]
    df = frame(spark, rows, "k string, ts double, v double")
    kept = epoch(track.suppress_repeats(df, "k", "ts", "v", slice_seconds=width), "ts")
    assert sorted(r.ts for r in kept.collect()) == [0.0, 2.0, 5.0]
    pairs = track.changed_pairs(df, "k", "ts", ["v"], slice_seconds=width)
    assert pairs.count() == 5


@pytest.mark.parametrize("width", WIDTHS)
def test_thinning(spark, width):
    rows = [("a", float(t), i) for i, t in enumerate((0, 10, 11, 12, 30))]
    df = frame(spark, rows, "k string, ts double, n int")
    every = ql.decimate(df, ["k"], "ts", 2, ["n"], width)
    assert sorted(r.n for r in every.collect()) == [0, 2, 4]
    some = ql.sdecimate(df, ["k"], "ts", 2, 5, ["n"], width)
    assert sorted(r.n for r in some.collect()) == [0, 1, 2, 4]


def test_grid_of_a_short_flight_is_empty(spark):
    rows = [("a", 1.2, 1.9), ("b", 1.2, 3.0)]
    df = spark.createDataFrame(rows, "k string, s double, e double").selectExpr(
        "k", "timestamp_micros(cast(round(s*1e6) as bigint)) s", "timestamp_micros(cast(round(e*1e6) as bigint)) e"
    )
    got = epoch(ql.second_grid(df, "s", "e", slice_seconds=1.0), "ts")
    assert sorted((r.k, r.ts) for r in got.collect()) == [("b", 2.0), ("b", 3.0)]


def test_top_planes(spark):
    rows = [("a", 5, 2.0, None, {0: 5}), ("b", 9, 1.0, "X1", {0: 4, 3: 5}), ("c", 5, 1.0, "", {1: 5})]
    df = spark.createDataFrame(
        rows, "icao string, packets bigint, first_packet double, callsign string, packet_type map<int,bigint>"
    )
    order = lambda k: [r.icao for r in track.top_planes(df, k).collect()]
    assert (order(0), order(1), order(9), order(-1)) == ([], ["b"], ["b", "c", "a"], ["b", "c", "a"])
    lines = [r.line for r in track.status_lines(df, -1).orderBy("packets", "icao").collect()]
    assert lines == ["a, (5, {0: 5})", "c, (5, {1: 5})", "b/X1 (9, {0: 4, 3: 5})"]
    message = track.status_message(track.status_lines(df, 2, advanced=False), 2).first().message
    assert message == "Top 2: b (9), c (5)"


def test_slice_width_follows_the_heaviest_key(spark):
    rows = [("hot", i / 10) for i in range(2000)] + [("cold", float(i)) for i in range(20)]
    df = frame(spark, rows, "k string, ts double")
    assert fit_slice_seconds(df, "k", "ts", 10_000) == 86400.0
    assert fit_slice_seconds(df, "k", "ts", 150) == 10.0


def test_heavy_keys_get_slices_of_their_own(spark):
    day = 86_400.0
    rows = [("busy", k * 0.5) for k in range(4000)] + [("burst", 10 * day + k * 0.01) for k in range(900)]
    rows += [(f"k{i}", i * day + k * 3000.0) for i in range(30) for k in range(20)]
    df = frame(spark, rows, "icao string, ts double")
    plan = fit_slices(df, "icao", "ts", target_rows=100)
    assert plan.seconds == day and {k for k, _ in plan.heavy} == {"busy", "burst"}
    counts = df.groupBy("icao", slice_id(F.unix_micros("ts"), plan).alias("s")).count().collect()
    assert max(r["count"] for r in counts) <= 100
    assert sum(r.icao not in ("busy", "burst") for r in counts) <= 30 * 2  # the others stay whole days
    assert fit_slices(df, "icao", "ts", target_rows=100, most_heavy=0).heavy == ()
    assert fit_slices(df.filter("false"), "icao", "ts").heavy == ()
