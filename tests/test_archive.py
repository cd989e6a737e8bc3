import random
import re

import pytest
from helpers import frame
from pyspark.sql import functions as F

from contrail import schema
from contrail.operators import track
from contrail.operators.enrich import with_registry
from contrail.operators.frames import dedup_within
from contrail.operators.intervals import STATE, TICKS, state_intervals
from contrail.operators.qualify import second_states
from contrail.operators.rules import load_rules
from contrail.plans import browse
from contrail.plans.archiving import archive_flights
from contrail.sources.archive import Archive, compact, drop_plane, read_archive, reset_archive, vacuum, write_archive
from contrail.sources.frames import read_frames, read_receivers
from contrail.sources.registry import read_registry
from contrail.sources.scratch import shared_dir
from contrail.streaming import jobs

SAVE = {"telemetry": {"default": "all", "altitude": "none"}, "calculated": {"default": "decimate(2)"}}
CONFIG = {
    "components": {"low": {"altitude": {"maximum": 1000}}, "soon": {"eta": {"maximum": 600}}},
    "categories": {"c": {"alert_method": "print", "save": SAVE}},
    "zones": {
        "z": {
            "coordinates": [[35.0, -79.0], [35.0, -78.0], [36.0, -78.0], [36.0, -79.0]],
            "levels": {
                "warn": {"category": "c", "requirements": "low and soon", "seconds": 20},
                "never": {"category": "c", "requirements": "low and soon", "seconds": 5000},
            },
        }
    },
}
COLS = (
    "icao string, ts double, hex string, type_cat int, callsign string, cat_tc int, cat_ca int, "
    "latitude double, longitude double, altitude double, horizontal_speed double, "
    "direction double, vertical_speed double"
)


def rows():
    out = []
    for icao, start, alt in (("AB0001", 1000.0, 500.0), ("AB0002", 1000.0, 5000.0), ("CD0003", 1500.0, 900.0)):
        for i in range(40):
            t = start + i
            out.append((icao, t, f"h{i:03}", 3, None, None, None, 34.9 + i / 1000, -78.5, alt, None, None, None))
        out.append((icao, start + 0.5, "hx", 1, "CALL" + icao[-1], 4, 3, None, None, None, None, None, None))
    return out


def messages(spark):
    return frame(spark, rows(), COLS)


def build(spark, width=10.0):
    flown = track.flights(messages(spark), "icao", "ts", 30, width)
    return archive_flights(flown, load_rules(CONFIG), slice_seconds=width)


def test_archive_round_trip_drop_and_reset(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert browse.archive_status(read_archive(spark, path)).first().planes == 0
    made = build(spark)
    assert write_archive(made, path, "one") == 2
    assert write_archive(made, path, "one") == 2  # a retry replaces the first attempt
    a = read_archive(spark, path)
    info = {r.icao: r for r in a.info.collect()}
    assert sorted(info) == ["ab0001", "cd0003"]
    first = info["ab0001"]
    assert (first.flight_id, first.packets, first.callsign) == ("1000-z-warn", 41, "CALL1")
    assert first.packet_type == {"1": 1, "3": 40} and first.plane_category == [4, 3]
    pieces = [r for r in a.series.collect() if r.icao == "ab0001"]
    sizes = {}
    for r in pieces:
        key = (r.category, r.type)
        sizes[key] = sizes.get(key, 0) + len(r.data)
    assert len(sizes) == len(schema.RECEIVED) + len(schema.CALCULATED)
    assert sizes["received_data", "latitude"] == 40
    assert sizes["received_data", "altitude"] == 0 and sizes["received_data", "direction"] == 0
    assert sizes["calculated_data", "horizontal_speed"] == 20
    status = browse.archive_status(a).first()
    assert (status.planes, status.flights) == (2, 2)
    one = read_archive(spark, path, "cd0003")
    assert [r.icao for r in browse.list_planes(one).collect()] == ["cd0003"]
    with pytest.raises(ValueError):
        drop_plane(spark, path, "ab0001")
    before = drop_plane(spark, path, "ab0001", confirm=True) - 1
    assert [r.icao for r in read_archive(spark, path).info.collect()] == ["cd0003"]
    assert read_archive(spark, path, version=before).info.count() == 2  # a reader of the version before
    assert _stored(spark, path) == {"ab0001", "cd0003"}
    assert vacuum(spark, path) > 0
    assert _stored(spark, path) == {"cd0003"}  # the bytes are gone
    assert [r.icao for r in read_archive(spark, path).info.collect()] == ["cd0003"]
    reset_archive(spark, path, confirm=True)
    assert read_archive(spark, path).info.count() == 0 and _stored(spark, path) == set()


def _stored(spark, path):
    """Aircraft in any file of the archive, listed by a version or not."""
    found = set()
    for name in ("series", "info"):
        found |= {r.icao for r in spark.read.schema("icao string").parquet(f"{path}/{name}").select("icao").distinct().collect()}
    return found


def test_compacting_and_writing_beside_it(spark, tmp_path, monkeypatch):
    path, made = str(tmp_path / "archive"), build(spark)
    for k in range(3):
        write_archive(made, path, f"s{k}")
    want = sorted(map(tuple, read_archive(spark, path).info.select("icao", "flight_id", "packets").collect()))
    assert compact(spark, path, most=5) is None
    compact(spark, path, most=2)
    got = read_archive(spark, path)
    assert sorted(map(tuple, got.info.select("icao", "flight_id", "packets").collect())) == want
    vacuum(spark, path)
    raw = spark.read.schema("icao string").parquet(f"{path}/info")
    assert raw.count() == len(want)  # superseded saves are gone
    fewer = Archive(*(df.filter("icao = 'ab0001'") for df in (made.series, made.info)))
    write_archive(fewer, path, "s2")  # replaces what compacting has merged
    assert [r.icao for r in read_archive(spark, path).info.collect()] == ["ab0001"]

    from contrail.sources import archive

    real, stale = archive._versions, []

    def versions(spark, path):
        now = real(spark, path)
        if not stale:
            stale.append(True)
            return now[:-1]  # another writer was faster
        return now

    number = max(real(spark, path))
    monkeypatch.setattr(archive, "_versions", versions)
    assert archive._commit(spark, path, lambda old: old) == number + 1


def test_slice_width_does_not_change_the_archive(spark):
    def content(archive):
        pairs = archive.series.selectExpr("icao", "flight_id", "category", "type", "inline(data)")
        return sorted(map(tuple, pairs.collect()))

    assert content(build(spark, 7.0)) == content(build(spark, 3600.0))


LATE = 10  # seconds


def _files(spark, path, data, parts):
    """Messages as several files, one per micro-batch: in time order but for shuffling within ``LATE`` seconds."""
    data = sorted(data, key=lambda r: r[1] + (ord(r[0][-1]) * 7 + ord(r[2][-1]) * 3) % LATE)
    size = len(data) // parts + 1
    for i in range(parts):
        part = frame(spark, data[i * size : (i + 1) * size], COLS)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _out(spark, df, path, checkpoint=None):
    jobs.start(df, jobs.table_sink(path), once=True, checkpoint=checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _passed(df, data):
    """What the watermark has passed: ``LATE`` seconds behind the newest row."""
    return df.filter(df.ts.cast("double") <= max(r[1] for r in data) - LATE)


def _same(got, want, *cols):
    return sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_streams_give_the_batch_result(spark, tmp_path):
    jobs.use_rocksdb(spark)
    stream = _files(spark, str(tmp_path / "in"), rows(), 4)
    kept = jobs.stream_dedup(stream, "icao", "ts", 5, ["hex"], f"{LATE} seconds")
    got = _out(spark, kept, str(tmp_path / "dedup"))
    want = dedup_within(messages(spark), "icao", "ts", 5, ["hex"])
    assert got.count() and _same(got, _passed(want, rows()), "icao", "ts", "hex")

    states = jobs.stream_states(stream, tie=["hex"], lateness=f"{LATE} seconds")
    got = _out(spark, states, str(tmp_path / "states"))
    flown = track.flights(messages(spark), "icao", "ts", 30)
    want = track.motion(flown, keys=["icao", "flight_start"], tie=["hex"])
    cols = ["icao", "flight_start", "ts", "hex", "latitude", "speed", "heading", "callsign"]
    assert got.count() and _same(got, _passed(want, rows()), *cols)


def test_restarted_stream_goes_on_and_late_rows_are_counted(spark, tmp_path):
    jobs.use_rocksdb(spark)
    source, path, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    data = sorted(rows(), key=lambda r: r[1])
    for part in (data[:50], data[50:]):
        stream = _files(spark, source, part, 2)
        kept = jobs.stream_dedup(stream, "icao", "ts", 5, ["hex"], f"{LATE} seconds")
        got = _out(spark, kept, path, check)
    want = dedup_within(messages(spark), "icao", "ts", 5, ["hex"])
    assert got.count() and _same(got, _passed(want, data), "icao", "ts", "hex")

    frame(spark, [("AB0001", 1.0, *data[0][2:])], COLS).coalesce(1).write.mode("append").parquet(source)
    frame(spark, [("AB0001", 9000.0, *data[0][2:])], COLS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(source)
    kept = jobs.stream_dedup(stream, "icao", "ts", 5, ["hex"], f"{LATE} seconds")
    query = jobs.start(kept, jobs.table_sink(path), once=True, checkpoint=check)
    query.awaitTermination()
    assert jobs.late_rows(query) == 1


def _archive(spark, source, data, tmp_path):
    stream = _files(spark, source, data, 2)
    path = str(tmp_path / "archive")
    queries = jobs.stream_archive(
        stream, load_rules(CONFIG), str(tmp_path / "staging"), path, str(tmp_path / "check"), 30, f"{LATE} seconds", once=True
    )
    for q in queries:
        q.awaitTermination()
    return sorted((r.icao, r.packets) for r in read_archive(spark, path).info.collect())


def test_stream_archive_saves_closed_flights_and_goes_on(spark, tmp_path):
    source = str(tmp_path / "in")
    # The last flight stays open: nothing has moved the watermark past its silence.
    assert _archive(spark, source, rows(), tmp_path) == [("ab0001", 41)]
    later = [("EF0004", 3000.0 + i, *rows()[0][2:]) for i in range(3)]
    assert _archive(spark, source, later, tmp_path) == [("ab0001", 41), ("cd0003", 41)]


def test_a_save_is_replaced_whole_and_the_latest_counts(spark, tmp_path):
    path, made = str(tmp_path / "archive"), build(spark)
    write_archive(made, path, "one")
    fewer = Archive(*(df.filter("icao = 'ab0001'") for df in (made.series, made.info)))
    write_archive(fewer, path, "one")
    assert [r.icao for r in read_archive(spark, path).info.collect()] == ["ab0001"]
    write_archive(made, path, "two")
    both = read_archive(spark, path)
    assert sorted(r.icao for r in both.info.collect()) == ["ab0001", "cd0003"]
    assert browse.dump(both).count() == browse.dump(made).count()


def test_no_machine_local_folder_on_a_cluster():
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "a", "getConf": staticmethod(dict)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    Cluster.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert shared_dir(Cluster) == "hdfs://shared"


def test_line_source_and_receivers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("*8D4840D6202CC371C32CE0576098;\n\n*5D4840D6000000;\n")
    got = read_frames(spark, str(tmp_path / "a.txt")).collect()
    assert [r.hex for r in got] == ["8D4840D6202CC371C32CE0576098", "5D4840D6000000"]
    config = {"receivers": {n: {"method": "dump1090", "arguments": {"path": str(tmp_path / "a.txt")}} for n in "xy"}}
    both = read_receivers(spark, config)
    assert sorted(r.receiver for r in both.collect()) == ["x", "x", "y", "y"]
    with pytest.raises(ValueError):
        read_receivers(spark, {"receivers": {"x": {"method": "other"}}})


def test_registry_file(spark, tmp_path):
    line = lambda icao, owner: ",".join([f"'{icao}'", *["''"] * 20, f"'{owner}'", *["''"] * 9])
    (tmp_path / "r.csv").write_text("\n".join([line("ab0001", "First, Inc"), line("ab0001", "Second")]))
    registry = read_registry(spark, str(tmp_path / "r.csv"))
    df = spark.createDataFrame([("AB0001",), ("FFFFFF",)], "icao string")
    got = {r.icao: r.reg_owner for r in with_registry(df, registry).collect()}
    assert got == {"AB0001": "First, Inc", "FFFFFF": None}


@pytest.mark.parametrize("width", [5.0, 37.0, 86400.0])
def test_stretches_say_what_every_second_says(spark, width):
    rnd = random.Random(3)
    rows = []
    for icao in ("A", "B", "C", "D"):
        for k in range(60):
            t = rnd.choice([rnd.randrange(0, 400), rnd.randrange(0, 400) + 0.5, rnd.random() * 400])
            lat, lon, alt, vs, speed, heading = (rnd.choice([None, None, float(rnd.randrange(3))]) for _ in range(6))
            rows.append((icao, 0.0, float(t), k, lat, lon, alt, vs, speed, None if icao == "C" else heading))
    series = frame(spark, rows, "icao string, start double, ts double, n int, latitude double, longitude double, altitude double, vertical_speed double, speed double, heading double")
    series = series.withColumn("flight_start", F.timestamp_micros(F.lit(250_000))).drop("start")
    ends = frame(spark, [("A", 400.0), ("B", 399.9), ("C", 400.0), ("D", 0.9)], "icao string, ts double").withColumnRenamed("ts", "flight_end")
    bounds = ends.withColumn("flight_start", F.timestamp_micros(F.lit(250_000)))
    args = (bounds, series.filter("unix_micros(ts) <= 400000000"), ["icao", "flight_start"], "ts", ["n"], 1, width)
    names = ["icao", "ts", *STATE]
    want = second_states(*args).select(*names)
    got = state_intervals(*args)
    each = got.withColumn("ts", F.explode(F.transform(F.sequence(F.lit(0), F.col(TICKS) - 1), lambda k: F.timestamp_micros(F.unix_micros("ts") + k * 1_000_000))))
    rows = sorted(map(tuple, each.select(*names).collect()), key=repr)
    assert rows == sorted(map(tuple, want.collect()), key=repr) and {r[0] for r in rows} == {"A", "B"}
    assert got.count() < len(rows) / 2


def test_stretches_shuffle_all_columns_of_a_slice_together(spark, tmp_path):
    rows = [("A", k // 5, k, k, *[float(k)] * 6) for k in range(9)]
    names = "icao string, start long, at long, n int, latitude double, longitude double, altitude double, vertical_speed double, speed double, heading double"
    made = spark.createDataFrame(rows, names).withColumns({"flight_start": F.timestamp_seconds("start"), "ts": F.timestamp_seconds("at")})
    made.write.parquet(str(tmp_path / "series"))
    series = spark.read.parquet(str(tmp_path / "series"))
    bounds = series.groupBy("icao", "flight_start").agg(F.max("ts").alias("flight_end"))
    found = state_intervals(bounds, series, ["icao", "flight_start"], "ts", ["n"], 1, 3.0)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not [x for x in dealt if "_col" in x or "_tick" in x]


def test_flights_of_few_messages_have_long_slices(spark, tmp_path):
    from contrail.catalog.base import DAY, flight_width, width

    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 30 as int), 0, 0, 0)"
    for name, busy in (("sparse", 40), ("busy", 1)):
        rows = spark.range(2_000 if name == "sparse" else 120_000).selectExpr("id AS event_id", f"{at} AS ts", f"id % {busy} AS user_id")
        rows.write.parquet(str(tmp_path / name / "events.parquet"))
    assert flight_width(spark, str(tmp_path / "sparse")) == 400 * DAY
    assert DAY < flight_width(spark, str(tmp_path / "busy")) < 25 * DAY
    assert width(spark, str(tmp_path / "sparse")) == DAY
