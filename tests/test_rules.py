import copy

import pytest
from helpers import frame

from contrail.operators.alerts import alerts, by_server, write_alerts
from contrail.operators.enrich import heavy_keys, lookup
from contrail.operators.rules import RuleError, level_hits, load_rules
from contrail.plans.settings import Settings, load_settings

SAVE = {"telemetry": {"default": "all"}, "calculated": {"default": "all"}}
RING = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
CONFIG = {
    "components": {"low": {"altitude": {"maximum": 1000}}, "soon": {"eta": {"maximum": 600}}},
    "categories": {
        "here": {"alert_method": "kafka", "arguments": {"server": "one:9092"}, "save": SAVE},
        "none": {"alert_method": "kafka", "save": SAVE},
        "said": {"alert_method": "print", "save": SAVE},
    },
    "zones": {
        "a": {"coordinates": RING, "levels": {
            "k": {"category": "here", "requirements": "low", "seconds": 1},
            "p": {"category": "said", "requirements": "not (low and soon) or not not soon", "seconds": 1}}},
        "b": {"coordinates": RING, "levels": {"n": {"category": "none", "requirements": "soon", "seconds": 1}}},
    },
}


@pytest.mark.parametrize("text", ["low low", "low and", "and low", "(low", "low)", "not", "()", "low not soon", "(low) soon", "", "low (soon)"])
def test_bad_requirements_are_refused_at_load(text):
    config = copy.deepcopy(CONFIG)
    config["zones"]["a"]["levels"]["k"]["requirements"] = text
    with pytest.raises(RuleError):
        load_rules(config)


def hits(spark):
    rows = [("x", 1.0, "a", 500.0, 900.0), ("y", 2.0, "b", 500.0, 30.0), ("z", 3.0, "a", None, 10.0)]
    columns = "icao string, ts double, zone string, altitude double, eta double"
    states = frame(spark, rows, columns).selectExpr(
        "*", "0D AS latitude", "0D AS longitude", "CAST(NULL AS string) AS callsign"
    )
    return alerts(level_hits(states, load_rules(CONFIG)))


def test_levels_of_the_own_zone_with_their_arguments(spark):
    got = sorted((r.icao, r.zone, r.type, r.alert_method, tuple(r.arguments.items())) for r in hits(spark).collect())
    assert got == [
        ("x", "a", "k", "kafka", (("server", "one:9092"),)), ("x", "a", "p", "print", ()),
        ("y", "b", "n", "kafka", ()), ("z", "a", "p", "print", ()),
    ]


def test_alerts_go_to_the_server_of_their_category(spark):
    sent = hits(spark).filter("alert_method = 'kafka'")
    assert {s: [r.icao for r in df.collect()] for s, df in by_server(sent, "other:1").items()} == {"one:9092": ["x"], "other:1": ["y"]}
    with pytest.raises(ValueError, match="server"):
        by_server(sent)


def test_printed_alerts(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    write_alerts(hits(spark), "print", path=path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert len(lines) == 2 and all(x.startswith('p {"icao":') for x in lines)
    write_alerts(hits(spark), "print")
    assert sorted(capsys.readouterr().out.strip().split("\n")) == lines
    with pytest.raises(ValueError, match="unknown"):
        write_alerts(hits(spark), "smoke")


def test_settings_of_a_configuration():
    config = {"general": {"backdate_packets": 4, "hz": 0.5, "duplicate_packet_merging": 7, "logs": "debug"}, "home": {"latitude": 1.5, "longitude": -2}}
    got = load_settings(config)
    assert (got.home, got.back_n, got.merge_seconds, got.hz) == ((1.5, -2.0), 4, 7.0, 0.5)
    assert (got.remember_seconds, got.top_planes, got.advanced) == (30.0, 5, True)
    assert load_settings({}) == Settings()
    for bad in ({"backdate_packets": 1}, {"remember_planes": -1}, {"hz": 0}, {"status_message_top_planes": -2}, {"hz": "fast"}, {"advanced_status": 1}):
        with pytest.raises(RuleError):
            load_settings({"general": bad})
    with pytest.raises(RuleError):
        load_settings({"home": {"latitude": 95, "longitude": 0}})


def test_lookup_spreads_only_heavy_keys(spark):
    rows = spark.createDataFrame([(k % 10 if k % 3 else 99, k) for k in range(900)] + [(None, 901)], "key long, n int")
    table = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 99)], "key long, v string")
    assert set(heavy_keys(rows, "key", 200)) == {99} and heavy_keys(rows, "key", 1000) == {}
    want = {(r.key, r.n): r.v for r in rows.join(table, "key", "left").collect()}
    for limit in (50, 200, 1000):
        got = lookup(rows, table, "key", rows_per_task=limit)
        assert got.count() == 901 and {(r.key, r.n): r.v for r in got.collect()} == want
