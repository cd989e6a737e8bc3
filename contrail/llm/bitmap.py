"""A set of hashes as a bitmap of fixed size: what it lacks is surely not in the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
_PIECE = 1 << 16  # bits set by one group


def bitmap(hashes: DataFrame) -> bytes:
    """Bits of the hashes in the only column of ``hashes`` (longs), compressed; at most ``BITS`` / 8 bytes."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(BITS))
    placed = hashes.select((at / _PIECE).cast("int").alias("piece"), (at % _PIECE).cast("int").alias("bit"))
    grouped = placed.groupBy("piece").agg(F.collect_set("bit").alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bits in b.column("bits"):
                flags = np.zeros(_PIECE, np.uint8)
                flags[bits.values.to_numpy()] = 1
                out.append(zstandard.compress(np.packbits(flags, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(out, pa.binary())], ["piece", "bytes"])

    whole = np.zeros(BITS // 8, np.uint8)
    for row in grouped.mapInArrow(packed, "piece int, bytes binary").collect():
        part = np.frombuffer(zstandard.decompress(bytes(row.bytes)), np.uint8)
        whole[row.piece * len(part) : (row.piece + 1) * len(part)] = part
    return zstandard.compress(whole.tobytes(), 1)


def unpacked(bits: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bits), np.uint8)


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are not in the set."""
    at = hashes.view(np.int64) & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
