"""Near-duplicates: SimHash fingerprints joined within a few differing bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import chunks, large_text
from contrail.llm.components import components
from contrail.llm.trie_join import hamming_links
from contrail.sources.scratch import materialize

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42  # Fixed value: the seed of the shingle hash.


def fingerprint(text: str, width: int) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles of ``width`` words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_ = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(set_).tobytes(), "big")


def shingle_array(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles; the whole sequence if it is shorter."""
    words = text.encode().translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = {digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def shingle_hashes(text: str, width: int) -> list[int]:
    """Hashes of the different shingles, as signed numbers; the whole sequence if it is shorter."""
    return shingle_array(text, width).view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fp (the fingerprint as a signed number) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = [fingerprint(t, width) for t in large_text(part.column("text")).to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("key"), fps], ["key", "fp"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = T.StructType().add("key", rows.schema["key"].dataType).add("fp", "long")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def near_duplicates(
    docs: DataFrame, width: int = 5, budget: int = 4, key: str = "doc_id", text: str = "text", leaf: int = 16_384
) -> DataFrame:
    """Components of rows whose fingerprints differ in at most ``budget`` bits, chained.

    One row per row of ``docs``: ``key``, fingerprint (16 hex digits) and component_id, the
    smallest key reachable, itself included. Rows without words have fingerprint zero and are
    linked like any others. Different fingerprints are joined once, however many rows have them.
    Repeated rows stay; null keys are ignored by component_id, which is null where no key of the
    component is known; other columns aren't read; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width, key, text).withColumnRenamed(key, "key"), "fingerprints")
    values = materialize(rows.groupBy("fp").agg(F.min("key").alias("first")), "different_fingerprints")
    roots = components(hamming_links(values.select("fp", F.col("fp").alias("id")), budget, leaf))
    owned = values.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    owned = materialize(owned, "fingerprint_roots")
    least = materialize(owned.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    classes = materialize(owned.join(least, "root").select("fp", "component_id"), "fingerprint_classes")
    out = rows.join(classes, "fp")
    return out.select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
