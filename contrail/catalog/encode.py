"""Frames made from the event table, to have decoder input whose meaning is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.catalog.base import events
from contrail.functions import modes
from contrail.functions.fence import computed

# Position of each printable character in the six-bit set (fixed values): A is 1, 0 is 48.
_LETTER_A, _DIGIT_0, _BLANK = 1, 48, 32


def pack(*fields: tuple[Column | int, int]) -> Column:
    """(value, width) fields, most significant first, as one long."""
    word = F.lit(0).cast("bigint")
    for value, width in fields:
        part = F.lit(value) if isinstance(value, int) else value
        word = F.shiftleft(word, width).bitwiseOR(part.cast("bigint"))
    return word


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event; which kind depends on ``event_id % 8``."""
    n = F.col("event_id")
    e = events(spark, sf_dir).withColumn(
        "address", (F.col("user_id") * 48271 + 4194304) % 16777215 + 1
    )
    odd = F.floor(n / 8) % 2
    cpr = ((odd, 1), (n * 7919 % 131072, 17), (n * 104729 % 131072, 17))
    digits = [(_DIGIT_0 + F.floor(n / 10**i) % 10, 6) for i in (3, 2, 1, 0)]
    ident = pack(
        (1 + n % 4, 5), (n % 7, 3), (_LETTER_A, 6), (_LETTER_A + 1, 6), *digits, (_BLANK, 6), (_BLANK, 6)
    )
    steps = n * 13 % 2048
    code = F.shiftleft(F.shiftright(steps, 4), 5).bitwiseOR(16).bitwiseOR(steps.bitwiseAND(15))
    baro = pack((9 + n % 10, 5), (0, 3), (code, 12), (0, 1), *cpr)
    gnss = pack((20 + n % 3, 5), (0, 3), (n * 17 % 4096, 12), (0, 1), *cpr)
    rate = ((0, 1), (n % 2, 1), (n % 400, 9), (0, 10))
    ground = pack(
        (19, 5), (1 + odd, 3), (0, 5), (n % 3 % 2, 1), (n * 3 % 1024, 10), (n % 5 % 2, 1),
        (n * 7 % 1024, 10), *rate,
    )
    air = pack(
        (19, 5), (3 + odd, 3), (0, 5), (F.when(n % 11 > 0, 1).otherwise(0), 1), (n * 3 % 1024, 10),
        (1, 1), (n * 7 % 1024, 10), *rate,
    )
    surface = pack(
        (5 + n % 4, 5), (n * 5 % 128, 7), (F.when(n % 13 > 0, 1).otherwise(0), 1),
        (n * 11 % 128, 7), (0, 1), *cpr,
    )
    kind, turn = n % 8, F.floor(n / 8) % 4
    other = kind == 7
    word = n * 31 % 16777216
    # DF17 unless it is an all-call reply (DF11) or a reply whose parity hides the address.
    reply = other & (turn < 2)
    short = (kind == 6) | (other & (turn == 0))
    parts = {
        "_first": F.when(kind == 6, 0x5D).when(reply & short, 0x20).when(reply, 0xA0).otherwise(0x8D),
        "_word": F.when(reply, word).otherwise(F.col("address")),
        "_field": F.when(kind == 1, baro).when(kind == 2, gnss).when(kind == 3, ground)
        .when(kind == 4, air).when(kind == 5, surface).when(other & (turn == 1), pack((word, 24), (word, 32)))
        .when(other & (turn == 2), pack((28, 5), (word, 51))).otherwise(ident),
        "_mask": F.when(reply, F.col("address")).when(other & (turn == 3), 1).otherwise(0).cast("bigint"),
        "_short": short,
    }
    made = computed(e, parts)
    top = pack((F.col("_first"), 8), (F.col("_word"), 24))
    made = computed(made, {
        "_hi": F.shiftleft(top, 24).bitwiseOR(
            F.when(F.col("_short"), 0).otherwise(F.shiftright("_field", 32)).cast("bigint")
        ),
        "_lo": F.shiftleft(F.col("_field").bitwiseAND(0xFFFFFFFF), 24),
    })
    crc = F.when(F.col("_short"), modes.crc(F.col("_hi"), None)).otherwise(
        modes.crc(F.col("_hi"), F.col("_lo"))
    )
    made = computed(made, {"_parity": crc.cast("bigint").bitwiseXOR(F.col("_mask"))})
    hex_ = F.when(F.col("_short"), _hex(F.col("_hi").bitwiseOR(F.col("_parity")), 14)).otherwise(
        F.concat(_hex(F.col("_hi"), 14), _hex(F.col("_lo").bitwiseOR(F.col("_parity")), 14))
    )
    made = computed(made, {"hex": hex_})
    return made.select("event_id", F.lit("main").alias("receiver"), "ts", "hex")
