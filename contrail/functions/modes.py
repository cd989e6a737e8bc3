"""Mode S / ADS-B bit fields as columns.

A frame is 14 or 28 hex digits. Its 112 bits do not fit a long, so a frame is held as two
56-bit halves; the 56-bit message field (ME) of an extended squitter fits one.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# CRC-24 generator without its top bit (fixed value).
GENERATOR = 0xFFF409

# Six-bit character set (fixed value).
CHARSET = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ#####_###############0123456789######"

# Surface movement code: first code of each step, speed there in knots, knots per code
# (fixed values).
MOVEMENT = (
    (2, 0.125, 0.125),
    (9, 1.0, 0.25),
    (13, 2.0, 0.5),
    (39, 15.0, 1.0),
    (94, 70.0, 2.0),
    (109, 100.0, 5.0),
)
MOVEMENT_STOPPED = 1
MOVEMENT_FASTEST = (124, 175.0)

# Unit factors (fixed values).
KNOT_KMH = 1.852
FOOT_M = 0.3048
FEET_PER_MINUTE_MS = 0.00508
FEET_PER_M = 3.28084

_LATITUDE_ZONES = 15


def bits(field: Column, first: int, count: int, width: int = 56) -> Column:
    """``count`` bits from bit ``first`` (0 = most significant) of a ``width``-bit long."""
    return F.shiftright(field, width - first - count).bitwiseAND((1 << count) - 1)


def hex_long(text: Column, start: int, digits: int) -> Column:
    """Hex digits ``start`` (1-based) onwards as a long; at most 15 digits."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def well_formed(text: Column) -> Column:
    return F.length(text).isin(14, 28) & text.rlike("^[0-9A-F]+$")


@functools.cache
def _remainders(shift_bytes: int) -> tuple[int, ...]:
    """Remainder of every byte value placed ``shift_bytes`` bytes before the frame's end."""
    table = []
    for byte in range(256):
        value = byte << 16
        for _ in range(8 * (shift_bytes - 2)):
            value <<= 1
            if value & 0x1000000:
                value ^= 0x1000000 | GENERATOR
        table.append(value)
    return tuple(table)


def _lookup(shift_bytes: int, byte: Column) -> Column:
    table = F.expr("array(" + ",".join(map(str, _remainders(shift_bytes))) + ")")
    return table[byte.cast("int")]


def crc(hi: Column, lo: Column | None) -> Column:
    """CRC-24 remainder of a frame: 0 for an intact DF17/18 frame.

    ``hi`` holds the first 7 bytes and ``lo`` the last 7; a short frame has ``hi`` only. The
    code is linear, so the remainder is the XOR of one table entry per byte.
    """
    halves = [hi] if lo is None else [hi, lo]
    total = 7 * len(halves)
    tail = halves[-1].bitwiseAND(0xFFFFFF).cast("int")
    for i in range(total - 3):
        byte = bits(halves[i // 7], 8 * (i % 7), 8)
        tail = tail.bitwiseXOR(_lookup(total - 1 - i, byte))
    return tail


def callsign(me: Column) -> Column:
    chars = [F.substring(F.lit(CHARSET), bits(me, 8 + 6 * i, 6).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.translate(F.concat(*chars), "#_", "")


def longitude_zones(lat: Column) -> Column:
    """Number of longitude zones (NL) at a latitude."""
    a = 1 - math.cos(math.pi / (2 * _LATITUDE_ZONES))
    c = F.cos(F.radians(F.abs(lat)))
    inner = F.floor(F.lit(2 * math.pi) / F.acos(1 - F.lit(a) / (c * c)))
    size = F.abs(lat)
    return (
        F.when(size < 1e-8, F.lit(59))
        .when(size == 87, F.lit(2))
        .when(size > 87, F.lit(1))
        .otherwise(inner)
        .cast("int")
    )


def _nearest(ref: float, zone: Column, fraction: Column) -> Column:
    """Coordinate with this zone size and fraction that lies closest to ``ref``."""
    at = F.lit(ref)
    index = F.floor(at / zone) + F.floor(0.5 + F.pmod(at, zone) / zone - fraction)
    return zone * (index + fraction)


def cpr_latitude(me: Column, ref_lat: float, span: float) -> Column:
    """Latitude of a compact position near the reference; span 360 airborne, 90 surface."""
    odd = bits(me, 21, 1) == 1
    zone = F.when(odd, F.lit(span / 59)).otherwise(F.lit(span / 60))
    return _nearest(ref_lat, zone, bits(me, 22, 17) / F.lit(131072.0))


def cpr_longitude(me: Column, lat: Column, ref_lon: float, span: float) -> Column:
    """Longitude of a compact position whose latitude is known."""
    zones = longitude_zones(lat) - bits(me, 21, 1)
    zone = F.when(zones > 0, F.lit(span) / F.greatest(zones, F.lit(1))).otherwise(F.lit(span))
    return _nearest(ref_lon, zone, bits(me, 39, 17) / F.lit(131072.0))


def _gray(code: Column) -> Column:
    """Gray code of up to 8 bits to its number."""
    for shift in (1, 2, 4):
        code = code.bitwiseXOR(F.shiftright(code, shift))
    return code


def altitude_feet(me: Column) -> Column:
    """Barometric altitude; NULL when not available.

    With the Q bit the code counts 25 ft; without it, 100 ft in Gillham order
    C1 A1 C2 A2 C4 A4 B1 Q B2 D2 B4 D4.
    """
    code = bits(me, 8, 12)
    fine = F.shiftleft(F.shiftright(code, 5), 4).bitwiseOR(code.bitwiseAND(15)) * 25 - 1000

    names = ("C1", "A1", "C2", "A2", "C4", "A4", "B1", "Q", "B2", "D2", "B4", "D4")
    bit = {n: bits(me, 8 + i, 1) for i, n in enumerate(names)}

    def joined(*order: str) -> Column:
        word = F.lit(0).cast("bigint")
        for i, n in enumerate(order):
            word = word + bit[n] * (1 << (len(order) - 1 - i))
        return word

    five_hundreds = _gray(joined("D2", "D4", "A1", "A2", "A4", "B1", "B2", "B4"))
    raw = _gray(joined("C1", "C2", "C4"))
    steps = F.when(raw == 7, F.lit(5)).otherwise(raw)
    hundreds = F.when(five_hundreds % 2 == 1, 6 - steps).otherwise(steps)
    coarse = F.when(
        ~raw.isin(0, 5, 6), five_hundreds * 500 + hundreds * 100 - 1300
    )
    return F.when(code == 0, None).when(bit["Q"] == 1, fine).otherwise(coarse).cast("double")


def gnss_altitude_m(me: Column) -> Column:
    """Satellite altitude in metres, through feet as received software reports it."""
    code = bits(me, 8, 12)
    return F.when(code != 0, code * F.lit(FEET_PER_M) * F.lit(FOOT_M))


def _signed(sign: Column, size: Column) -> Column:
    return F.when(sign == 1, -size).otherwise(size)


def airborne_velocity(me: Column) -> tuple[Column, Column, Column]:
    """(speed in knots, direction in degrees, climb in ft/min) of type code 19.

    Subtypes 1 and 2 give ground speed and track, 3 and 4 airspeed and heading; 2 and 4 count
    4 knots. A zero field means not available.
    """
    subtype = bits(me, 5, 3)
    scale = F.when(subtype.isin(2, 4), F.lit(4)).otherwise(F.lit(1))
    first, second = bits(me, 14, 10), bits(me, 25, 10)
    known = (first != 0) & (second != 0)
    ground = subtype.isin(1, 2)
    air = subtype.isin(3, 4)

    east = _signed(bits(me, 13, 1), (first - 1) * scale)
    north = _signed(bits(me, 24, 1), (second - 1) * scale)
    east, north = east.cast("double"), north.cast("double")
    track = F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))
    heading = F.when(bits(me, 13, 1) == 1, first * F.lit(360.0 / 1024))
    speed = F.when(known & ground, F.hypot(east, north)).when(
        known & air, ((second - 1) * scale).cast("double")
    )
    direction = F.when(known & ground, track).when(known & air, heading)
    rate = bits(me, 37, 9)
    climb = F.when(rate != 0, _signed(bits(me, 36, 1), (rate - 1) * 64)).cast("double")
    return speed, direction, climb


def surface_velocity(me: Column) -> tuple[Column, Column]:
    """(speed in knots, track in degrees) of a surface position."""
    code = bits(me, 5, 7)
    speed = F.when(code == MOVEMENT_STOPPED, F.lit(0.0)).when(
        code == MOVEMENT_FASTEST[0], F.lit(MOVEMENT_FASTEST[1])
    )
    ends = [first for first, _, _ in MOVEMENT[1:]] + [MOVEMENT_FASTEST[0]]
    for (first, knots, step), end in zip(MOVEMENT, ends, strict=True):
        speed = speed.when(
            (code >= first) & (code < end), F.lit(knots) + (code - first) * F.lit(step)
        )
    track = F.when(bits(me, 12, 1) == 1, bits(me, 13, 7) * F.lit(360.0 / 128))
    return speed, track
