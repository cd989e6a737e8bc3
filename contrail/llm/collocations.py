"""Phrase collocations by dynamic itemset counting.

The corpus is coded once into shards, which are then scanned in turn, again and again. A scan
counts phrases of all lengths together: a phrase starts to be counted behind the scan in which
both its parts (without its last, without its first word) have reached the threshold, and is
counted for one full cycle of shards. Each phrase first adds to one of a number of hashed
counters, which follows the words of the corpus up to a limit; a counter is at least as high as the
count of any of its phrases, so what is active follows from the scans in which counters have
reached the threshold, which every task holds. The counts themselves are a table, added up piece
by piece. A phrase whose counter has reached the threshold is counted exactly for one full cycle
behind that scan.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.batches import chunks, large_text
from contrail.sources.scratch import materialize, new_path

BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\v\f\r" else b for b in range(256))
SEGMENT = 4 << 20  # bytes of text coded at once
NEVER = 255
CELLS = 1 << 16  # counters sent as one piece
JOINED = 256  # pieces of one place added up at once
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 27  # for phrases of one length
WORD_COUNTERS = 1 << 24  # at most, for words
PIECES = 64  # given out together
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = 200_000  # different words counted together in a task
ROWS = 1 << 21  # phrase counts held in a task, and half of the counters
BUCKETS = 32  # parts of a language whose best phrases meet
_CODED = "shard int, ids array<long>, codes binary, lang string, words array<string>, names array<long>, counts array<long>"
_SCANNED = "length int, phrase binary, n long, piece int, source int, cells binary"


def _segments(texts: list[str]) -> Iterator[bytes]:
    """Lower-cased bytes with breaks between pieces, cut at breaks into segments of about ``SEGMENT`` bytes."""
    data = BREAK.join(t.encode() for t in texts).translate(_TABLE)
    start = 0
    while start < len(data):
        stop = len(data)
        if stop - start > SEGMENT:
            stop = data.rfind(BREAK, start + 1, start + SEGMENT) + 1 or data.find(BREAK, start + SEGMENT) + 1 or stop
        yield data[start:stop]
        start = stop


def _coded(segment: bytes, seed: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different words, their ids (0: a break) and counts, and the number of each token's word."""
    tokens = pa.array(segment.replace(BREAK, b" \xff ").split(), pa.large_binary()).dictionary_encode()
    names, codes = tokens.dictionary.to_pylist(), tokens.indices.to_numpy(zero_copy_only=False)
    ids = np.array([0 if w == BREAK else xxhash.xxh3_64_intdigest(w, seed) | 1 for w in names], np.uint64)
    broken = ids[codes] == 0
    codes = codes[~(broken & np.r_[True, broken[:-1]])]
    counts = np.where(ids == 0, 0, np.bincount(codes, minlength=len(names)))
    return names, ids, counts, codes.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)


def _encode(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows of segments of a language (ids of their words, codes), dealt to shards, and rows of word counts of a task
    (lang, words, names, counts); written as a table with a folder for each shard."""

    def batch(**columns) -> pa.RecordBatch:
        kinds = {"shard": pa.int32(), "ids": pa.list_(pa.int64()), "codes": pa.binary(), "lang": pa.string(), "words": pa.list_(pa.string()), "names": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], k) for c, k in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held = TaskContext.get().partitionId(), {}

        def counted(lang: str, most: int) -> Iterator[pa.RecordBatch]:
            own = held[lang]
            if len(own) > most:
                names = [v[0] for v in own.values()]
                yield batch(shard=turn % shards, lang=lang, words=[w.decode() for w in own], names=names, counts=[v[1] for v in own.values()])
                own.clear()

        for part in chunks(batches, most=SEGMENT):
            texts, langs = large_text(part.column("text")).to_pylist(), part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                salt, own = xxhash.xxh3_64_intdigest(lang.encode(), seed), held.setdefault(lang, {})
                for segment in _segments([t for t, x in zip(texts, langs) if x == lang]):
                    words, ids, counts, codes = _coded(segment, salt)
                    names = ids.view(np.int64)
                    for w, name, n in zip(words, names.tolist(), counts.tolist()):
                        if name:
                            own.setdefault(w, [name, 0])[1] += n
                    yield batch(shard=turn % shards, ids=names, codes=codes.tobytes())
                    yield from counted(lang, WORDS)
                    turn += 1
        for lang in held:
            yield from counted(lang, 0)

    path = new_path(rows.sparkSession, "coded")
    rows.mapInArrow(run, _CODED).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(_CODED).parquet(path)


def _words(coded: DataFrame) -> DataFrame:
    """lang, word, id, n of every different word."""
    each = coded.filter("words is not null").select("lang", F.inline(F.arrays_zip("words", "names", "counts")))
    return each.groupBy("lang", F.col("words").alias("word"), F.col("names").alias("id")).agg(F.sum("counts").alias("n"))


def fit_counters(words: int) -> int:
    """Counters for the phrases of one length: an eighth of all words or more, within what tasks can hold."""
    return max(LEAST_COUNTERS, min(MOST_COUNTERS, 1 << (words // 8).bit_length()))


def sizes_of(counters: int, longest: int) -> list[int]:
    """Numbers of counters by length."""
    return [min(counters, WORD_COUNTERS), *[counters] * (longest - 1)]


def bucket_of(hashes: np.ndarray, counters: int) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(32)) * _MIX >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _counted(words: np.ndarray, hashes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of ``words``, their hashes and counts; equal rows have equal hashes (a row may come in several parts)."""
    order = np.argsort(hashes)
    words = words[order]
    starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(1)])
    counts = np.diff(np.r_[starts, len(words)]) if n is None else np.add.reduceat(n[order], starts)
    return words[starts], hashes[order[starts]], counts


class Scan:
    """One task's part of scan ``step``: hashed counters of what is active, and exact counts of what has reached.

    ``reached`` has for each length the scan in which each counter reached ``least``, or NEVER; None: no counter has.
    """

    def __init__(self, step: int, cycle: int, least: int, sizes: list[int], reached: list[np.ndarray | None]):
        self.step, self.cycle, self.least, self.sizes, self.reached = step, cycle, least, sizes, reached
        self.sums: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in reached]
        self.exact: list[list[tuple[np.ndarray, ...]]] = [[] for _ in reached]

    def add(self, ids: np.ndarray) -> None:
        """Count the phrases of a run of word ids (0: a break)."""
        hashes, valid = ids.copy(), ids != 0
        ready = np.full(len(ids), -1, np.int16)  # the scan by which both parts have reached
        for k, reached in enumerate(self.reached):
            if k:
                if len(hashes) < 2:
                    return
                hashes = (hashes[:-1] ^ hashes[:-1] >> np.uint64(29)) * _MIX + ids[k:]
                valid, ready = valid[:-1] & valid[1:], np.maximum(ready[:-1], ready[1:])
            valid &= ready < NEVER
            at = np.flatnonzero(valid)
            since, bucket = ready[at], bucket_of(hashes[at], self.sizes[k])
            now = (since < self.step) & (self.step <= since + self.cycle)
            cells, n = np.unique(bucket[now], return_counts=True)
            if len(cells):
                self.sums[k].append((cells.astype(np.uint32), np.minimum(n, self.least).astype(cells_type(self.least))))
            own = np.full(len(at), NEVER, np.int16) if reached is None else reached[bucket].astype(np.int16)
            own = np.where(own < NEVER, np.maximum(own, since + 1), NEVER)
            if k:
                exact = at[(own < self.step) & (self.step <= own + self.cycle)]
                if len(exact):
                    self.exact[k].append(_counted(np.stack([ids[exact + i] for i in range(k + 1)], 1), hashes[exact]))
            ready = np.full(len(hashes), NEVER, np.int16)
            ready[at] = own

    def taken(self, most: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, phrases and exact counts where more than ``most`` rows are held, added up over the runs.

        Phrases that begin alike lie together, which makes the table small.
        """
        for k, parts in enumerate(self.exact):
            if sum(len(p[2]) for p in parts) > most:
                words, _, n = parts[0] if len(parts) == 1 else _counted(*(np.concatenate(x) for x in zip(*parts)))
                self.exact[k] = []
                order = np.lexsort(words.T[-2::-1])
                yield k + 1, words[order], n[order]

    def pieces(self, most: int = 0) -> Iterator[tuple[int, int, bytes]]:
        """Length, place and packed counters where more than ``most`` are held, without pieces that are all zero."""
        for k, parts in enumerate(self.sums):
            if sum(len(p[0]) for p in parts) <= most:
                continue
            cells, n = (np.concatenate(x) for x in zip(*parts))
            self.sums[k] = []
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            n = np.minimum(np.add.reduceat(n[order], starts, dtype=np.int64), self.least).astype(cells_type(self.least))
            cells = cells[starts].astype(np.int64)
            places, first = np.unique(cells // CELLS, return_index=True)
            for place, low, high in zip(places.tolist(), first, np.r_[first[1:], len(cells)]):
                part = np.zeros(min(CELLS, self.sizes[k]), n.dtype)
                part[cells[low:high] - place * CELLS] = n[low:high]
                yield k + 1, place, zstandard.compress(part.tobytes(), 1)


def cells_type(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _unpacked(sizes: list[int], pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray | None]:
    """The scan in which each counter of each length reached, from the pieces in which any has."""
    reached: list[np.ndarray | None] = [None] * len(sizes)
    for length, place, packed in pieces:
        if reached[length - 1] is None:
            reached[length - 1] = np.full(sizes[length - 1], NEVER, np.uint8)
        reached[length - 1][place * CELLS : (place + 1) * CELLS] = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return reached


def _scan(shard: DataFrame, step: int, cycle: int, least: int, sizes: list[int], shared) -> DataFrame:
    """Rows of exact counts (length, phrase, n) and of counters (length, piece, source, cells)."""

    def batch(**columns) -> pa.RecordBatch:
        kinds = {"length": pa.int32(), "phrase": pa.binary(), "n": pa.int64(), "piece": pa.int32(), "source": pa.int32(), "cells": pa.binary()}
        size = len(next(iter(columns.values())))
        made = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(made, list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(step, cycle, least, sizes, _unpacked(sizes, shared.value))

        def rows(most: int = 0) -> Iterator[pa.RecordBatch]:
            for length, words, n in scan.taken(most):
                raw = words.astype(">u8").tobytes()
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * length), len(n), [None, pa.py_buffer(raw)])
                yield batch(length=np.full(len(n), length), phrase=names.cast(pa.binary()), n=n)
            for some in itertools.batched(scan.pieces(2 * most), PIECES):
                length, piece, cells = zip(*some)
                yield batch(length=length, piece=piece, source=[TaskContext.get().partitionId()] * len(some), cells=cells)

        for b in batches:
            for i in range(b.num_rows):
                own = b.column("ids")[i].values.to_numpy().view(np.uint64)
                raw = b.column("codes")[i].as_buffer()
                scan.add(own[np.frombuffer(raw, np.uint16 if len(own) <= 1 << 16 else np.uint32)])
                yield from rows(ROWS)
        yield from rows()

    return shard.filter("ids is not null").select("ids", "codes").mapInArrow(run, _SCANNED)


def _total(packed: pa.Scalar, least: int) -> np.ndarray:
    """The sum of a list of packed counters."""
    kind = cells_type(least)
    parts = (np.frombuffer(zstandard.decompress(p.as_py()), kind).astype(np.int64) for p in packed.values)
    return functools.reduce(lambda x, y: np.minimum(x + y, least), parts).astype(kind)


def _added(rows: DataFrame, least: int) -> DataFrame:
    """length, piece and the sum of ``all``, a list of packed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [zstandard.compress(_total(packed, least).tobytes(), 1) for packed in b.column("all")]
            yield pa.RecordBatch.from_arrays([b.column("length"), b.column("piece"), pa.array(out, pa.binary())], ["length", "piece", "cells"])

    return rows.mapInArrow(run, "length int, piece int, cells binary")


def _add_up(scanned: DataFrame, before: DataFrame | None, step: int, least: int) -> DataFrame:
    """Counters behind scan ``step``: length, piece, cells, reached (the scan in which each reached) and latest of these.

    A scan's counters are added up by bounded groups first, then with those ``before``.
    """
    parts = scanned.filter("cells is not null").groupBy("length", "piece", F.expr(f"source div {JOINED}"))
    rows = _added(parts.agg(F.collect_list("cells").alias("all")), least).withColumn("reached", F.lit(None).cast("binary"))
    if before is not None:
        rows = rows.union(before.select("length", "piece", "cells", "reached"))
    grouped = rows.groupBy("length", "piece").agg(F.collect_list("cells").alias("all"), F.first("reached", True).alias("reached"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, steps, latest = [], [], []
            for packed, old in zip(b.column("all"), b.column("reached").to_pylist()):
                total = _total(packed, least)
                reached = np.full(len(total), NEVER, np.uint8) if old is None else np.frombuffer(zstandard.decompress(old), np.uint8)
                reached = np.where((total >= least) & (reached == NEVER), np.uint8(step), reached)
                cells.append(zstandard.compress(total.tobytes(), 1))
                steps.append(zstandard.compress(reached.tobytes(), 1))
                latest.append(int(np.max(reached, where=reached < NEVER, initial=0)) if (reached < NEVER).any() else None)
            made = [pa.array(cells, pa.binary()), pa.array(steps, pa.binary()), pa.array(latest, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("length"), b.column("piece"), *made], ["length", "piece", "cells", "reached", "latest"])

    return grouped.mapInArrow(run, "length int, piece int, cells binary, reached binary, latest int")


def _last_step(latest: dict[int, int], cycle: int) -> int:
    """The last scan that any phrase known so far can need, from the latest scan in which counters of a length reached."""
    last, end = cycle - 1, -1
    for length in range(1, len(latest) + 1):
        if length not in latest:
            break
        end = max(latest[length], end + 1)
        last = max(last, end + cycle)
    return last


def _phrases(coded: DataFrame, least: int, longest: int, cycle: int, counters: int) -> DataFrame:
    """length, phrase (ids, eight bytes each) and count a of all phrases of 2 to ``longest`` words with ``least`` occurrences."""
    spark, sizes = coded.sparkSession, sizes_of(counters, longest)
    scans, step, known, reached, latest = [], 0, None, [], {}
    while step <= _last_step(latest, cycle):
        shared = spark.sparkContext.broadcast(reached)
        scanned = _scan(coded.filter(F.col("shard") == step % cycle), step, cycle, least, sizes, shared)
        path = new_path(spark, "scan")
        scanned.write.option("compression", "zstd").parquet(path)
        scanned = spark.read.schema(scanned.schema).parquet(path)
        known = materialize(_add_up(scanned, known, step, least), "counters")
        shared.destroy()  # what it was needed for is written
        rows = known.filter("latest is not null").select("length", "piece", "reached", "latest").collect()
        reached, latest = [(r.length, r.piece, bytes(r.reached)) for r in rows], {}
        for r in rows:
            latest[r.length] = max(r.latest, latest.get(r.length, 0))
        scans.append(scanned.filter("phrase is not null").select("length", "phrase", "n"))
        step += 1
    found = functools.reduce(DataFrame.union, scans).groupBy("length", "phrase").agg(F.sum("n").alias("a"))
    return materialize(found.filter(F.col("a") >= least), "phrases")


def collocations(
    docs: DataFrame, least: int = 10, longest: int = 3, absorb: int = 50, most: int = 2000, shards: int = 3,
    counters: int | None = None, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The best ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what spaces and tabs leave inside pieces between ``.,;:!?`` and line ends, A-Z in
    lower case; phrases lie in one piece of one text. Candidates have 2 to ``longest`` words and
    a >= ``least`` occurrences. A cut behind the first k words gives l and r, the counts of both
    parts, and floor(1000000 a a / (l r)); the cut of least score counts, then the smallest k.
    A candidate inside a longer one that has ``absorb`` percent of its occurrences is dropped,
    whether that one is dropped or not. Order: score, a (both falling), phrase by its bytes; n is
    the number of words of the language. Numbers are exact up to a of 10^16.

    A null text is empty, a null language is ``und``; repeated rows count again; other columns
    aren't read; an empty table gives an empty result. Every task holds ``counters`` (a power of two) bytes for each
    length; if none are given they follow the number of words, up to ``MOST_COUNTERS``. Where far more phrases than
    counters occur, more of them are counted exactly, with the same result. ``shards`` is at most 60.
    """
    if counters is not None and (counters & counters - 1 or counters < 2) or not 1 <= shards <= 60 or longest < 2:
        raise ValueError("counters is a power of two, shards 1 to 60, longest 2 or more")
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    for seed in range(4):
        coded = _encode(rows, shards, seed)
        words = materialize(_words(coded), "words")
        if not words.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").take(1):
            break  # no two words have one id
    else:
        raise RuntimeError("words with equal hashes under every seed")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counters = counters or fit_counters(words.agg(F.sum("n")).first()[0] or 0)
    found = _phrases(coded, least, longest, shards, counters)
    name = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    single = words.filter(F.col("n") >= least).select(name.alias("phrase"), "lang", "word", F.col("n").alias("a"))
    known = {1: materialize(single.withColumnRenamed("word", "text"), "single_words")}
    number = lambda c: F.col(c).cast("decimal(16,0)")
    for length in range(2, longest + 1):
        now = found.filter(F.col("length") == length).select("phrase", "a")
        for k in range(1, length):
            first, rest = F.substring("phrase", 1, 8 * k), F.substring("phrase", 8 * k + 1, 8 * (length - k))
            side = lambda m, c: known[m].select(F.col("phrase").alias(c), "lang", "text", F.col("a").alias("f"))
            left, right = side(k, "first").alias("x"), side(length - k, "rest").alias("y")
            now = now.withColumns({"first": first, "rest": rest}).join(left, "first").withColumnsRenamed({"lang": "own", "text": "t", "f": "l"})
            now = now.join(right.drop("lang"), "rest").withColumnsRenamed({"text": "u", "f": "r"})
            score = (number("a") * number("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("p")
            now = now.withColumn("p", score).withColumn("q", number("l") * number("r"))
            one = F.struct(F.expr("cast(p div q as long)").alias("score"), F.lit(k).alias("k"), "l", "r")
            before = [F.col("cut")] if k > 1 else []
            now = now.select("phrase", "a", F.col("own").alias("lang"), F.concat_ws(" ", "t", "u").alias("text"), F.least(*before, one).alias("cut") if before else one.alias("cut"))
            if k < length - 1:
                now = now.drop("lang", "text")
        known[length] = materialize(now, f"phrases_of_{length}")
    kept = []
    for length in range(2, longest + 1):
        inside = [
            known[longer].select(F.explode(F.array(*[F.substring("phrase", 8 * i + 1, 8 * length) for i in range(longer - length + 1)])).alias("phrase"), "a")
            for longer in range(length + 1, longest + 1)
        ]
        own = known[length]
        if inside:
            over = functools.reduce(DataFrame.union, inside).groupBy("phrase").agg(F.max("a").alias("over"))
            over = materialize(over, "longer_phrases")
            own = own.join(over, "phrase", "left").filter(F.expr(f"over is null or 100 * over < {absorb} * a")).drop("over")
        kept.append(own.select("lang", "text", "a", "cut"))
    best = functools.reduce(DataFrame.union, kept).withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(BUCKETS)))
    for group in (["lang", "bucket"], ["lang"]):  # first the best of each part of a language
        order = Window.partitionBy(*group).orderBy(F.desc("cut.score"), F.desc("a"), "text")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"
    )
