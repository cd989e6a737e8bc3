"""Arrow helpers shared by the operators: bounded chunks of texts inside a task."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def give_back() -> None:
    """Return unused memory to the system: workers stay for later tasks, which may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def once(make: Callable) -> Callable:
    """Compute a result once for each worker process.

    Unlike a cached function of the library this one travels to workers that lack the package.
    """

    @functools.wraps(make)
    def call(*args):
        kept = sys.modules.setdefault("_contrail_kept", types.ModuleType("_contrail_kept")).__dict__
        key = make.__module__, make.__qualname__, args
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return call


def carried(docs: DataFrame, columns: tuple[str, ...], text: str) -> list[Column]:
    """Columns that come along unread, as one struct that no name can clash with; the text travels once, outside."""
    others = [docs[c] for c in columns if c != text]
    return [F.struct(*others).alias("carried")] if others else []


def whole(columns: tuple[str, ...], text: str) -> list[Column]:
    """The struct of all ``columns`` again, from text and carried; nothing if there are none."""
    parts = [F.col("text").alias(c) if c == text else F.col("carried")[c].alias(c) for c in columns]
    return [F.struct(*parts).alias("carried")] if parts else []


def large_text(column: pa.Array) -> pa.Array:
    """A text column with 64-bit offsets; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string or large_binary array and the n + 1 offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
