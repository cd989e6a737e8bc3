import pytest
from helpers import frame

from contrail.functions import modes
from contrail.operators.frames import adsb_only, decode_messages, valid_frames, with_fields

SCHEMA = "receiver string, ts double, hex string"


def decode(spark, *hexes, **options):
    df = frame(spark, [("r", float(i), h) for i, h in enumerate(hexes)], SCHEMA)
    return [r.asDict() for r in decode_messages(df, **options).orderBy("ts").collect()]


def test_published_frames(spark):
    ident, one, two, ground, air = decode(
        spark,
        "8D4840D6202CC371C32CE0576098", "8D40621D58C382D690C8AC2863A7",
        "8D40621D58C386435CC412692AD6", "8D485020994409940838175B284F",
        "8DA05F219B06B6AF189400CBC33F", home_lat=52.258, home_lon=3.918,
    )
    assert (ident["icao"], ident["callsign"], ident["cat_tc"], ident["cat_ca"]) == ("4840D6", "KLM1023", 4, 0)
    assert (one["latitude"], one["longitude"]) == pytest.approx((52.25720, 3.91937), abs=1e-5)
    assert one["altitude"] == pytest.approx(11582.4)
    assert (two["latitude"], two["longitude"]) == pytest.approx((52.26578, 3.93891), abs=1e-5)
    assert ground["horizontal_speed"] == pytest.approx(159.20 * 1.852, abs=0.01)
    assert ground["direction"] == pytest.approx(182.88, abs=0.01)
    assert ground["vertical_speed"] == pytest.approx(-832 * 0.00508)
    assert air["horizontal_speed"] == pytest.approx(375 * 1.852)
    assert air["direction"] == pytest.approx(243.98, abs=0.01)
    assert air["vertical_speed"] == pytest.approx(-2304 * 0.00508)


def test_surface_frame(spark):
    (m,) = decode(spark, "8C4841753A9A153237AEF0F275BE", home_lat=51.990, home_lon=4.375)
    assert m["type_cat"] == 2
    assert (m["latitude"], m["longitude"]) == pytest.approx((52.32056, 4.73574), abs=1e-5)
    assert m["horizontal_speed"] == pytest.approx(17 * 1.852)
    assert m["direction"] == pytest.approx(92.81, abs=0.01)


def test_unused_and_invalid_frames_are_dropped(spark):
    def typed(tc):
        return f"8D40621D{tc << 3:02X}C382D690C8AC000000"

    bad = [typed(tc) for tc in (0, 23, 28, 29, 31)]
    bad += ["8D000000202CC371C32CE0576098", "nothex", "8D4840", ""]
    assert decode(spark, *bad) == []


def test_sign_of_life(spark):
    (m,) = decode(spark, "5D4840D6000000")
    assert (m["icao"], m["type_cat"], m["latitude"]) == ("4840D6", 0, None)


def test_missing_field_drops_the_message(spark):
    # Airspeed subtype with the heading status bit cleared.
    me = int("8DA05F219B06B6AF189400CBC33F"[8:22], 16) & ~(1 << (55 - 13))
    hex_ = f"8DA05F21{me:014X}000000"
    assert decode(spark, hex_) == []
    (m,) = decode(spark, hex_, keep_partial=True)
    assert m["direction"] is None and m["horizontal_speed"] == pytest.approx(375 * 1.852)


def test_validity(spark):
    good = "8D4840D6202CC371C32CE0576098"
    rows = [("r", 0.0, good), ("r", 1.0, good[:-1] + "9"), ("r", 2.0, "5D4840D6000000"), ("r", 3.0, good[:14])]
    df = frame(spark, rows, SCHEMA)
    assert sorted(r.hex for r in valid_frames(df).collect()) == ["5D4840D6000000", good]
    assert adsb_only(with_fields(df)).count() == 3


def gillham(feet):
    """100-ft altitude code as a 12-bit field, by the definition of the code."""
    total = (feet + 1200) // 100
    fives, hundreds = divmod(total, 5)
    # Codes 1, 2, 3, 4, 7 stand for the five steps, in reverse order in every second block.
    step = hundreds + 1
    if fives % 2:
        step = 6 - step
    if step == 5:
        step = 7
    gray = lambda n: n ^ (n >> 1)
    g500, g100 = gray(fives), gray(step)
    bit = dict(zip(("D2", "D4", "A1", "A2", "A4", "B1", "B2", "B4"), f"{g500:08b}"))
    bit |= dict(zip(("C1", "C2", "C4"), f"{g100:03b}"))
    bit["Q"] = "0"
    order = ("C1", "A1", "C2", "A2", "C4", "A4", "B1", "Q", "B2", "D2", "B4", "D4")
    return int("".join(bit[n] for n in order), 2)


def test_gillham_altitudes(spark):
    feet = list(range(-1200, 60000, 100))
    rows = [(f, gillham(f) << 36) for f in feet]
    df = spark.createDataFrame(rows, "feet int, me bigint")
    got = df.select("feet", modes.altitude_feet(df.me).alias("alt")).collect()
    assert [(r.feet, r.alt) for r in got if r.alt != r.feet] == []
