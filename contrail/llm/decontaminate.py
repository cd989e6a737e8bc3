"""Benchmark decontamination: an FM-index for each shard of documents, searched for test phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import carried, chunks, large_text, whole
from contrail.llm.fm_index import FMIndex
from contrail.sources.scratch import materialize

# A-Z become a-z; every other byte outside 0-9, a-z and 0x80-0xFF parts words.
_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass
class Phrases:
    """Windows of test items as rows of word numbers (from 2 on), with the items of each."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases(items: list[tuple[str, str]], width: int) -> Phrases:
    """Windows of ``width`` consecutive words; an item of fewer words is one window, of none has none."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words(text)]
        for i in range(max(1, len(found) - width + 1) if found else 0):
            windows.setdefault(tuple(found[i : i + width]), set()).add(item)
    rows = np.zeros((len(windows), width), np.int64)
    for i, window in enumerate(windows):
        rows[i, : len(window)] = window
    return Phrases(vocabulary, rows, np.array([len(w) for w in windows], np.int64), [sorted(x) for x in windows.values()])


def _hits(texts: list[str], p: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged spans of hit words and items found, by text; the texts are one shard."""
    get, codes, sizes = p.vocabulary.get, [], []
    for text in texts:
        found = words(text)
        sizes.append(len(found))
        codes.append(np.fromiter(map(get, found, repeat(1)), np.int64, len(found)))
        codes.append(np.ones(1, np.int64))  # 1: a word that no phrase has, or the end of a document
    all_ = np.concatenate(codes)
    spans, items = [[] for _ in texts], [set() for _ in texts]
    if not len(p.rows):
        return sizes, spans, items
    # Only unbroken stretches of phrase words as long as the shortest phrase can hold one.
    stops = np.flatnonzero(all_ == 1)
    length = np.diff(np.r_[-1, stops])
    length[length <= p.lengths.min()] = 0
    kept = np.repeat(length > 0, np.diff(np.r_[-1, stops]))
    origin = np.flatnonzero(kept)
    if not len(origin):
        return sizes, spans, items
    phrase, at = FMIndex(all_[origin]).occurrences(p.rows, p.lengths)
    start = origin[at]
    edge = np.zeros(len(all_) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + p.lengths[phrase], -1)
    hit = np.cumsum(edge) > 0
    change = np.flatnonzero(np.diff(np.r_[False, hit]))
    first = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
    for a, b in change.reshape(-1, 2).tolist():
        doc = int(np.searchsorted(first, a, side="right")) - 1
        spans[doc].append((a - int(first[doc]), b - int(first[doc])))
    doc_of = np.searchsorted(first, start, side="right") - 1
    for doc, which in np.unique(np.stack([doc_of, phrase]), axis=1).T.tolist():
        items[doc].update(p.items[which])
    return sizes, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Test items in blocks of about ``most`` bytes, so that what is broadcast stays bounded."""
    rows = benchmark.select(benchmark[item].cast("string").alias("i"), benchmark[text].alias("t")).dropna()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= most:
            yield block
            block, size = [], 0
    yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    share: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    block_bytes: int = 8 << 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words of ``docs`` that lie in an occurrence of a test phrase.

    A phrase is ``width`` consecutive words of a test item, or all words of a shorter item. One row
    per row of ``docs``: ``key``, n_words, n_hit, n_items, items (ids of the items found, sorted as
    strings), spans (merged, of word numbers from 0, end excluded), items_sha256 (of the ids joined
    by commas) and contaminated (n_hit > 0 and share * n_hit >= n_words). Each chunk of a task is a
    shard with an index of its own; no shuffle. A null or empty text has no words; repeated rows
    and null keys stay; other columns aren't read, but those of ``carry`` come along as the struct
    carried; empty tables give no rows, or no hits. Test
    items without id or text have no phrases. Items are broadcast in blocks of ``block_bytes``;
    with several blocks the documents pass once for each, through tables in the shared folder.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *carried(docs, carry, text))
    along = rows.columns[2:]
    kind = rows.schema["key"].dataType
    pairs = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType().add("key", kind).add("text", "string").add("n_words", "long")
    schema = schema.add("spans", pairs).add("items", T.ArrayType(T.StringType()))
    for c in along:
        schema = schema.add(c, rows.schema[c].dataType)
    context = rows.sparkSession.sparkContext

    def search(blocks: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        known = Phrases(*shared.value)
        for part in chunks(blocks):
            n, spans, items = _hits(large_text(part.column("text")).to_pylist(), known)
            if "spans" in part.schema.names:
                before = zip(part.column("spans").to_pylist(), part.column("items").to_pylist())
                for i, (s, x) in enumerate(before):
                    spans[i] = _merged(spans[i] + [tuple(y) for y in s])
                    items[i].update(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    part.column("text"),
                    pa.array(n, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                + [part.column(c) for c in along],
                ["key", "text", "n_words", "spans", "items", *along],
            )

    for number, block in enumerate(_blocks(benchmark, item, text, block_bytes)):
        if number and not block:
            break
        if number:
            rows = materialize(rows, "decontaminate")
        shared = context.broadcast(tuple(vars(phrases(block, width)).values()))  # plain values: workers may lack this package
        rows = rows.mapInArrow(lambda x, shared=shared: search(x, shared), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = rows.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), *whole(carry, text),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
