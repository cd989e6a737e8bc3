import json
import math
import random

import pytest
from pyspark.sql import functions as F

from contrail.functions import geo
from contrail.operators import ray_grid, zones
from contrail.operators import rules as ru
from contrail.operators.alerts import alerts, to_kafka_rows
from contrail.operators.ray_grid import zone_eta_by_grid
from contrail.operators.zones import rule_states, zone_eta, zone_parts

SQUARE = ru.Zone("square", ((35.0, -79.0), (35.0, -78.0), (36.0, -78.0), (36.0, -79.0)))
NOTCH = ru.Zone("notch", ((35.0, -79.0), (35.0, -78.0), (36.0, -78.0), (36.0, -78.2), (35.2, -78.5), (36.0, -78.8), (36.0, -79.0)))
POINT = ru.Zone("point", ((35.5, -78.5),) * 4)
SAVE = {"telemetry": {"default": "all"}, "calculated": {"default": "all"}}


def states(spark, *rows):
    return spark.createDataFrame(
        [(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)],
        "i int, latitude double, longitude double, speed double, heading double",
    )


def eta(spark, zone, *rows, **options):
    got = zone_eta(states(spark, *rows), [zone], **options).orderBy("i").collect()
    return [(r.inside, r.eta) for r in got]


def test_inside_edge_and_speed(spark):
    got = eta(
        spark, SQUARE, (35.5, -78.5, 0, 0), (34.5, -78.5, 0, 0), (34.5, -78.5, 360, 0),
        (34.5, -78.5, 360, 180), (35.0, -78.5, 360, 180), (34.5, -78.5, None, None),
    )
    assert got[0] == (True, 0.0)
    assert got[1] == (False, math.inf)
    assert got[2][1] == pytest.approx(0.5 * 110.94 / 360 * 3600, rel=1e-3)
    assert got[3] == (False, math.inf)
    assert got[4] == (False, 0.0)  # on the border: not inside, reached at once
    assert got[5] == (False, math.inf)


def test_concave_zone_first_crossing(spark):
    # Heading east through the notch: the first of several crossings counts.
    (got,) = eta(spark, NOTCH, (35.7, -79.5, 500, 90))
    assert got[1] == pytest.approx(0.5 * 90.5 / 500 * 3600, rel=5e-3)


def test_degenerate_zone(spark):
    (r,) = zone_eta(states(spark, (35.5, -78.0, 500, 270)), [POINT], with_distance=True).collect()
    assert (r.inside, r.eta) == (False, math.inf)
    assert r.distance_km == pytest.approx(0.5 * 90.7, rel=2e-3)


def test_many_zones_in_parts(spark):
    zones = [ru.Zone(f"z{i}", SQUARE.ring) for i in range(5)]
    assert [len(p) for p in zone_parts(zones, 8)] == [2, 2, 1]


def vincenty_km(lat1, lon1, lat2, lon2):
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    el = math.radians(lon2 - lon1)
    lam = el
    for _ in range(100):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        ca2 = 1 - sa * sa
        cm = c - 2 * math.sin(u1) * math.sin(u2) / ca2
        k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        lam = el + (1 - k) * f * sa * (sigma + k * s * (cm + k * c * (2 * cm * cm - 1)))
    uu = ca2 * (a * a - b * b) / (b * b)
    big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    d = big_b * s * (cm + big_b / 4 * (c * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return b * big_a * (sigma - d)


def test_distance_and_destination_agree(spark):
    from pyspark.sql import functions as F

    pairs = [(35.0, -79.0, 36.0, -78.0), (10.0, 20.0, -40.0, 80.0), (60.0, -10.0, 61.0, 170.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = geo.with_distance(df, F.col("a"), F.col("b"), F.col("c"), F.col("d"), "km").collect()
    for r in got:
        assert r.km == pytest.approx(vincenty_km(r.a, r.b, r.c, r.d), rel=1e-5)
    same = geo.with_distance(df, F.col("a"), F.col("b"), F.col("a"), F.col("b"), "km").collect()
    assert [r.km for r in same] == [0.0] * 3
    there = geo.with_destination(
        df.withColumns({"h": F.lit(77.0)}), "a", "b", "h", F.lit(1234.5), "y", "x"
    ).collect()
    for r in there:
        assert vincenty_km(r.a, r.b, r.y, r.x) == pytest.approx(1234.5, rel=1e-7)


def config(**level):
    body = {"category": "c", "requirements": "near", "seconds": 60} | level
    return {
        "components": {"near": {"eta": {"maximum": 120}}, "low2": {"altitude": {"maximum": 1000}}},
        "categories": {"c": {"alert_method": "kafka", "save": SAVE}},
        "zones": {"z": {"coordinates": [list(p) for p in SQUARE.ring], "levels": {"warn": body}}},
    }


@pytest.mark.parametrize("level", [
    {"category": "nobody"}, {"requirements": "unknown"}, {"seconds": 0}, {"seconds": 1.5}, {"seconds": "x"},
    {"requirements": "near; drop"}, {"requirements": "__import__('os')"}, {"requirements": ""},
])
def test_bad_rules(level):
    with pytest.raises(ru.RuleError):
        ru.load_rules(config(**level))


@pytest.mark.parametrize("text", ["all", "none", "decimate(10)", "sdecimate(1,10)", "sdecimate(1, 10)"])
def test_save_methods(text):
    assert ru.save_method(text).kind == text.split("(")[0]


@pytest.mark.parametrize("text", ["some", "decimate", "decimate()", "decimate(0)", "sdecimate(1)", "sdecimate(1,)"])
def test_bad_save_methods(text):
    with pytest.raises(ru.RuleError):
        ru.save_method(text)


def test_missing_datum_fails_and_endless_eta_is_null(spark):
    r = ru.load_rules(config(requirements="low2 or not near"))
    rows = states(spark, (34.0, -78.5, 300, 180)).selectExpr(
        "'A' AS icao", "timestamp_seconds(0) AS ts", "latitude", "longitude", "speed", "heading",
        "cast(null as double) AS altitude",
    )
    made = alerts(ru.level_hits(rule_states(rows, r), r))
    (row,) = to_kafka_rows(made).collect()
    assert (row.topic, row.key) == ("warn", "A")
    value = json.loads(row.value)
    assert value["eta"] is None and value["payload"]["altitude"] is None and "icao" not in value


def test_rays_over_a_grid_against_every_zone(spark):
    rnd = random.Random(4)
    rings = {}
    for i in range(60):
        lat, lon, h = rnd.uniform(35, 36), rnd.uniform(-79, -78), rnd.choice([0.002, 0.03, 0.4])
        turn = [rnd.uniform(0.2, 1) for _ in range(rnd.randrange(3, 8))]
        rings[f"z{i}"] = [(lat + h * r * math.sin(6.28 * k / len(turn)), lon + h * r * math.cos(6.28 * k / len(turn))) for k, r in enumerate(turn)]
    rings["edge"] = [(35.25, -78.75), (35.25, -78.5), (35.5, -78.5), (35.5, -78.75)]  # on the lines of the grid
    rings["point"] = [(35.5, -78.5)] * 3
    rows = [(k, rnd.uniform(34.9, 36.1), rnd.uniform(-79.1, -77.9), rnd.choice([0.0, 5.0, 400.0, None]), rnd.choice([0.0, 90.0, 180.0, 270.0, rnd.uniform(0, 360), None])) for k in range(300)]
    rows += [rows[0], (900, 35.25, -78.9, 300.0, 90.0), (901, None, -78.0, 100.0, 10.0), (902, 35.3, -78.6, 100.0, 10.0)]
    positions = spark.createDataFrame(rows, "id int, latitude double, longitude double, speed double, heading double")
    names = "zone string, ring array<struct<lat:double,lon:double>>"
    table = spark.createDataFrame(list(rings.items()), names)
    every = zone_eta(positions, [ru.Zone(n, tuple(r)) for n, r in rings.items()], 3000)
    want = sorted((r.id, r.zone, r.inside, round(r.eta, 6)) for r in every.collect() if r.eta < math.inf)
    assert len({r[1] for r in want}) > 30 and {r[2] for r in want} == {True, False}
    for size in (0.05, 0.25, 3.0):
        got = zone_eta_by_grid(positions, table, 3000, size)
        assert sorted((r.id, r.zone, r.inside, round(r.eta, 6)) for r in got.collect()) == want


def test_many_pieces_of_zones_are_not_sent_to_the_driver(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, rnd.uniform(34.9, 36.5), rnd.uniform(-79.1, -77.5), 400.0, rnd.uniform(0, 360)) for i in range(100)] + [(100, None, -78.0, 5.0, 0.0)]
    positions = spark.createDataFrame(rows, "id int, latitude double, longitude double, speed double, heading double")
    corner = lambda i: (35 + i / 60, -79 + i / 70)
    rings = [(f"z{i}", [(y, x), (y, x + 1), (y + 1, x + 1), (y + 1, x)]) for i, (y, x) in enumerate(map(corner, range(30)))]
    table = spark.createDataFrame(rings, "zone string, ring array<struct<lat:double,lon:double>>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, many = (zones.containing_zones(positions, table, size) for size in (0.25, 0.02))
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    found = sorted((r.id, r.zone) for r in many.collect())
    assert found == sorted((r.id, r.zone) for r in few.collect()) and len(found) > 100
    want = sorted(map(tuple, zone_eta_by_grid(positions, table, 3000).collect()))
    monkeypatch.setattr(zones, "BROADCAST_EDGES", 100)
    got = zone_eta_by_grid(positions, table, 3000)
    assert "SortMergeJoin" in plan(got) and sorted(map(tuple, got.collect())) == want


def test_positions_of_one_file_are_dealt_into_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ray_grid, "PART_ROWS", 10)
    rows = [(i, 35.0 + i / 200, -78.9, 600.0, 90.0) for i in range(100)]
    spark.createDataFrame(rows, "id int, latitude double, longitude double, speed double, heading double").coalesce(1).write.parquet(str(tmp_path / "p"))
    ring = [(34.0, -78.5), (34.0, -78.0), (36.0, -78.0), (36.0, -78.5)]
    zones = spark.createDataFrame([("wall", ring)], "zone string, ring array<struct<lat:double,lon:double>>")
    zones.write.parquet(str(tmp_path / "z"))
    got = ray_grid.zone_eta_by_grid(*(spark.read.parquet(str(tmp_path / name)) for name in "pz"))
    tasks = got.select("id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.id for r in tasks) == list(range(100))
    assert len({r.task for r in tasks}) > 4


def test_only_wanted_distances(spark):
    rows = states(spark, (34.5, -78.5, 360, 180), (35.9, -78.6, 360, 180))
    d = {(r.i, r.zone): r for r in zone_eta(rows, [SQUARE, POINT], with_distance=True, distance_to=["point"]).collect()}
    every = {(r.i, r.zone): r for r in zone_eta(rows, [SQUARE, POINT], with_distance=True).collect()}
    for k, r in d.items():
        assert (r.inside, r.eta) == (every[k].inside, every[k].eta)
        assert r.distance_km == (every[k].distance_km if k[1] == "point" else None)
    assert len(d) == 4


def test_edges_of_few_zones_are_compiled(spark, monkeypatch, capsys):
    rnd = random.Random(5)
    lat, lon, speed = (34.0, 34.9, 35.0, 35.2, 35.5, 36.0, 36.4), (-79.4, -79.0, -78.5, -78.2, -78.0, -77.6), (0.0, 5.0, 400.0)
    rows = [
        (a + rnd.choice((0.0, rnd.uniform(-0.3, 0.3))), b + rnd.choice((0.0, rnd.uniform(-0.3, 0.3))), rnd.choice(speed), rnd.choice((0.0, 90.0, 180.0, 270.0, rnd.uniform(0, 360))))
        for a in lat for b in lon for _ in range(4)
    ]
    rows += [(None, -78.0, 100, 10), (35.5, None, 100, 10), (34.5, -78.5, None, 0), (34.5, -78.5, 360, None)]
    again = ru.Zone("square", ((36.0, -77.9), (36.5, -77.5), (36.0, -77.5)))  # a name may come twice

    def results(**options):
        frame = zone_eta(states(spark, *rows), [SQUARE, NOTCH, POINT, again], **options)
        frame.explain()
        return sorted(map(repr, frame.collect())), capsys.readouterr().out

    for options in ({}, {"with_distance": True}, {"with_distance": True, "distance_to": ["notch", "point"]}, {"with_distance": True, "distance_to": []}):
        with monkeypatch.context() as m:
            m.setattr(zones, "COMPILED_EDGES", 0)
            want, plan = results(**options)
            assert "transform(" in plan
        got, plan = results(**options)
        assert got == want
        assert "transform(" not in plan
    assert zone_eta(states(spark, *rows), []).count() == 0


def test_zones_without_levels_are_not_judged():
    level = {"category": "c", "requirements": "near", "seconds": 1}
    other = {"category": "c", "requirements": "soon", "seconds": 1}
    ring = [[35.0, -79.0], [35.0, -78.0], [36.0, -78.0]]
    rules = ru.load_rules({
        "components": {"near": {"distance": {"maximum": 1}}, "soon": {"eta": {"maximum": 9}}},
        "categories": {"c": {"alert_method": "print", "save": SAVE}},
        "zones": {n: {"coordinates": ring, "levels": x} for n, x in (("a", {"l": level}), ("b", {"l": other}), ("c", {}))},
    })
    assert [z.name for z in rules.with_levels().zones] == ["a", "b"]
    assert rules.with_levels().levels == rules.levels and rules.distance_zones == ["a"]
