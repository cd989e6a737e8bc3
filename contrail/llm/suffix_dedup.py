"""Exact substring dedup: remove every byte of a string of ``width`` bytes that occurs more than once.

Two equal strings hold the same anchor at the same place: the k-gram of least hash, the leftmost
of equals. So only suffixes that start at anchors are sorted. All strings that share an anchor in
a text form one stretch around it. Equal stretches are counted first; of each different one whose
anchor occurs elsewhere a single copy goes on. Sampled splitters range-partition these copies by
their suffix from the anchor; a task sorts its bucket by multikey quicksort, forwards from the
anchor and backwards before it, and finds equal strings from common prefix lengths. What may
continue in a neighbouring bucket is compared across the boundary: digests of the strings that
its common prefixes leave open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.batches import chunks, flat_bytes, large_text
from contrail.sources.scratch import materialize

GRAM = 64
SEGMENT = 2 << 20  # bytes whose anchors are found at once
BUCKET = 20_000  # stretches compared at once, if no anchor has more
_POSITION = np.uint64((1 << 24) - 1)
_RANDOM = np.random.default_rng(7)
_OF_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each position on."""
    h = _OF_BYTE[data]
    for k in range(gram.bit_length() - 1):
        m = 1 << k
        h = h[:-m] * _FACTORS[k] + h[m:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First start, last start and anchor of each stretch, the anchor's hash, and the text it is in.

    ``data`` holds texts end to end (at most 2^24 bytes); strings of ``width`` bytes stay inside one.
    """
    none = (np.zeros(0, np.int64),) * 5
    n = len(data) - width + 1
    if n <= 0:
        return none
    hashes, w = gram_hashes(data, gram), width - gram + 1
    key = hashes & ~_POSITION | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _POSITION).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    starts = np.flatnonzero(offsets[doc + 1] - np.arange(n) >= width)
    if not len(starts):
        return none
    a, d = anchor[starts], doc[starts]
    new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    at = a[first]
    return starts[first], starts[last], at, hashes[at].view(np.int64), d[first]


def _anchors(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """key, digest (of the text), start, span (last start - start), lead (anchor - start), anchor hash a, stretch hash s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=SEGMENT):
            texts = large_text(part.column("text"))
            data, offsets = flat_bytes(texts)
            digests = np.array([xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(offsets, offsets[1:])], np.uint64)
            step = max(SEGMENT, 2 * width) if len(texts) == 1 else len(data) + 1
            for base in range(0, max(1, len(data)), step):  # a long text goes on in pieces that overlap
                piece = data[base : base + step + width - 1]
                ends = np.array([0, len(piece)]) if len(texts) == 1 else offsets
                first, last, at, a, doc = stretches(piece, ends, width, gram)
                raw = piece.tobytes()
                s = [xxhash.xxh3_64_intdigest(raw[x : y + width]) for x, y in zip(first.tolist(), last.tolist())]
                start = first + base - (0 if len(texts) == 1 else offsets[doc])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(doc)), pa.array(digests[doc].view(np.int64)), pa.array(start),
                        pa.array((last - first).astype(np.int16)), pa.array((at - first).astype(np.int16)), pa.array(a),
                        pa.array(np.array(s, np.uint64).view(np.int64)),
                    ],
                    ["key", "digest", "start", "span", "lead", "a", "s"],
                )

    schema = T.StructType().add("key", rows.schema["key"].dataType).add("digest", "long").add("start", "long")
    schema = schema.add("span", "short").add("lead", "short").add("a", "long").add("s", "long")
    return rows.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """key, digest and the compressed text, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in chunks(batches):
            raw = [t.encode() for t in large_text(part.column("text")).to_pylist()]
            digests = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64)
            packed = pa.array([pack(x) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(digests), packed], ["key", "digest", "packed"])

    schema = T.StructType().add("key", rows.schema["key"].dataType).add("digest", "long").add("packed", "binary")
    return rows.mapInArrow(run, schema)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of big-endian words: all runs that are still tied are parted by the next word at once."""
    n = len(words)
    order, run, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for column in range(words.shape[1]):
        if not len(tied):
            break
        rows = order[tied]
        word = words[rows, column]
        sorted_ = np.lexsort((word, run[tied]))
        order[tied] = rows[sorted_]
        word, runs = word[sorted_], run[tied]
        new = np.r_[True, (runs[1:] != runs[:-1]) | (word[1:] != word[:-1])]
        run[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.diff(np.r_[np.flatnonzero(new), len(tied)])
        tied = tied[np.repeat(size > 1, size)]
    return order


def common_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal bytes at the start of each row and the one before it in order; 0 for the first."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    differ = words[order[1:]] ^ words[order[:-1]]
    column = (differ != 0).argmax(1)
    word = differ[np.arange(len(differ)), column]
    same = np.zeros(len(word), np.int64)
    for shift in (32, 16, 8):
        zero = word >> np.uint64(64 - shift) == 0
        same += np.where(zero, shift // 8, 0)
        word = np.where(zero, word << np.uint64(shift), word)
    lengths = np.where(differ.any(1), column * 8 + same, words.shape[1] * 8)
    return np.r_[0, lengths]


def _words(strings: list[bytes], size: int) -> np.ndarray:
    """Strings as rows of big-endian words, padded with zero bytes to ``size`` (a multiple of 8)."""
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in strings), ">u8").astype(np.uint64).reshape(-1, size // 8)


def _classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = multikey_order(words)
    return order, common_prefix(words, order)


def equal_strings(
    forward: list[bytes], backward: list[bytes], lead: np.ndarray, span: np.ndarray, copies: np.ndarray, width: int,
    least: np.ndarray | None = None, most: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of ``width`` bytes around anchors, by the anchor's place d in them.

    ``forward`` is each stretch from its anchor on, ``backward`` the bytes before it, reversed;
    copies says how often a stretch occurs. ``least`` and ``most`` may narrow d. Yields d, the
    stretches with such a string, a class for each (equal if the strings are), and whether the
    string occurs more than once here.
    """
    size = -(-width // 8) * 8
    (ahead, common_ahead), (back, common_back) = (_classes(_words(x, size)) for x in (forward, backward))
    n = len(forward)
    class_ahead, class_back = np.empty(n, np.int64), np.empty(n, np.int64)
    low = lead - span if least is None else np.maximum(lead - span, least)
    high = lead if most is None else np.minimum(lead, most)
    for d in range(int(low.min()), int(high.max()) + 1):
        there = np.flatnonzero((low <= d) & (d <= high))
        if not len(there):
            continue
        class_ahead[ahead] = np.cumsum(common_ahead < width - d)
        class_back[back] = np.cumsum(common_back < d) if d else 0
        code = class_ahead[there] * (n + 1) + class_back[there]
        _, which = np.unique(code, return_inverse=True)
        total = np.bincount(which, copies[there])
        yield d, there, which, total[which] > 1


def _columns(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema)], [n for n, _ in schema])


def _numbers(rows: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([r[n] for r in rows], np.int64) for n in names]


def _runs(hit: np.ndarray, rows: list[dict]) -> list[tuple]:
    """a, s and the first and last start of each run of hits; stretches with copies are known to be repeated."""
    hit = hit & np.array([r["copies"] < 2 for r in rows])[:, None]
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, x), (_, y) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return [(rows[i]["a"], rows[i]["s"], p, q - 1) for i, p, q in zip(row.tolist(), x.tolist(), y.tolist())]


def _compare(buckets: DataFrame, width: int, gram: int) -> DataFrame:
    """Starts x..y (from a stretch's own) of strings that are repeated inside a bucket.

    Stretches of the first and the last anchor of a bucket also give a row with null x: their
    anchor may go on in the next bucket.
    """

    def found(rows: list[dict], opens: set[bytes]) -> pa.RecordBatch:
        lead, span, copies = _numbers(rows, "lead", "span", "copies")
        hit = np.zeros((len(rows), width), bool)
        for d, there, _, twice in equal_strings([r["ahead"] for r in rows], [r["back"] for r in rows], lead, span, copies, width):
            hit[there[twice], lead[there[twice]] - d] = True
        done = _runs(hit, rows)
        done += [(r["a"], r["s"], None, None) for r in rows if r["ahead"][:gram] in opens]
        return _columns(done, [("a", pa.int64()), ("s", pa.int64()), ("x", pa.int32()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, first, start = [], None, 0  # start: where the last anchor's stretches begin
        for b in batches:
            for r in b.to_pylist():
                anchor = r["ahead"][:gram]
                first = anchor if first is None else first
                if rows and anchor != rows[-1]["ahead"][:gram]:
                    if len(rows) >= BUCKET:
                        yield found(rows, {first})
                        rows = []
                    start = len(rows)
                rows.append(r)
        if rows:
            yield found(rows, {first, rows[start]["ahead"][:gram]})

    return buckets.mapInArrow(run, "a long, s long, x int, y int")


def _limits(rows: list[dict], column: str, gram: int, width: int) -> np.ndarray:
    """The longest prefix of ``column`` that each row shares with any other of its anchor, rows being sorted by it.

    At the ends of a bucket the neighbour is elsewhere, so nothing is ruled out there.
    """
    words = _words([r[column] for r in rows], -(-width // 8) * 8)
    common = np.minimum(common_prefix(words, np.arange(len(rows))), width)
    new = np.array([True] + [p["ahead"][:gram] != r["ahead"][:gram] for p, r in zip(rows, rows[1:])])
    before = np.where(new, 0, common)
    before[0] = width
    return np.maximum(before, np.r_[before[1:], width])


def _back_limits(members: DataFrame, width: int, gram: int) -> DataFrame:
    """a, s, most: how far back each stretch agrees with any other of its anchor, in buckets sorted that way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            most = _limits(rows, "back", gram, width)
            kinds = [("a", pa.int64()), ("s", pa.int64()), ("most", pa.int32())]
            yield _columns([(r["a"], r["s"], m) for r, m in zip(rows, most.tolist())], kinds)

    return members.mapInArrow(run, "a long, s long, most int")


def _across(members: DataFrame, width: int, gram: int) -> DataFrame:
    """a, s, x, y and digest h of the strings that may be repeated in another bucket, m (2 if they are in this one).

    Only strings within the common prefixes of their stretch, forwards and backwards, are named;
    one that is repeated in the bucket is named once, and its stretches have rows without h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        lead, span, copies, most = _numbers(rows, "lead", "span", "copies", "most")
        least = width - _limits(rows, "ahead", gram, width)
        hit = np.zeros((len(rows), width), bool)
        out, strings = [], ([r["ahead"] for r in rows], [r["back"] for r in rows])
        for d, there, which, twice in equal_strings(*strings, lead, span, copies, width, least, most):
            hit[there[twice], lead[there[twice]] - d] = True
            for k in np.unique(which, return_index=True)[1].tolist():
                r, x = rows[there[k]], int(lead[there[k]]) - d
                h = xxhash.xxh3_128_digest(r["back"][:d][::-1] + r["ahead"][: width - d])
                out.append((None, None, None, None, h, 2) if twice[k] else (r["a"], r["s"], x, x, h, 1))
        out += [(*r, None, 0) for r in _runs(hit, rows)]
        kinds = [("a", pa.int64()), ("s", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("h", pa.binary()), ("m", pa.int64())]
        yield _columns(out, kinds)

    return members.mapInArrow(run, "a long, s long, x int, y int, h binary, m long")


def _copies(rows: DataFrame, undecided: DataFrame, width: int) -> DataFrame:
    """One copy of each stretch: a, s, copies, lead, span, ahead (bytes from the anchor on), back (before it, reversed)."""
    wanted = undecided.select(F.struct("rep.key", "rep.digest").alias("d"), F.struct("a", "s", "copies", "rep.start", "span", "lead").alias("one"))
    wanted = wanted.groupBy("d").agg(F.collect_list("one").alias("all"))
    texts = _packed(rows).withColumn("d", F.struct("key", "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, all_ = _unpack(b.column("packed")[i].as_py()), b.column("all")[i].as_py()
                ahead = [text[r["start"] + r["lead"] : r["start"] + r["span"] + width] for r in all_]
                back = [text[r["start"] : r["start"] + r["lead"]][::-1] for r in all_]
                columns = [pa.array([r[c] for r in all_], k) for c, k in (("a", pa.int64()), ("s", pa.int64()), ("copies", pa.int64()), ("lead", pa.int16()), ("span", pa.int16()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ahead, pa.binary()), pa.array(back, pa.binary())], ["a", "s", "copies", "lead", "span", "ahead", "back"])

    schema = T.StructType().add("a", "long").add("s", "long").add("copies", "long").add("lead", "short").add("span", "short")
    return texts.join(wanted, "d").select("packed", "all").mapInArrow(run, schema.add("ahead", "binary").add("back", "binary"))


def repeated_starts(rows: DataFrame, width: int, gram: int = GRAM) -> DataFrame:
    """key, digest, start, stop: where strings begin that occur more than once (stop excluded)."""
    anchors = materialize(_anchors(rows, width, gram), "anchors")
    # Aggregates are written before rows of the same key meet them, so that a hot key can be split.
    again = materialize(anchors.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "again")
    anchors = materialize(anchors.join(again, "a"), "repeated_anchors")
    place = F.struct("key", "digest", "start")
    kinds = anchors.groupBy("a", "s").agg(F.count("*").alias("copies"), F.min(place).alias("rep"), F.first("span").alias("span"), F.first("lead").alias("lead"))
    kinds = materialize(kinds, "stretches")
    mixed = materialize(kinds.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "mixed")
    ones = materialize(_copies(rows, kinds.join(mixed, "a"), width), "copies")
    size = ones.agg(F.sum(F.octet_length("ahead") + F.octet_length("back")).alias("n")).first().n or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20))
    buckets = ones.repartitionByRange(parts, "ahead", "back").sortWithinPartitions("ahead", "back")
    compared = materialize(_compare(buckets, width, gram), "compared")
    members = ones.join(compared.filter("x is null").select("a", "s"), ["a", "s"], "left_semi")
    members = materialize(members, "members").withColumn("anchor", F.substring("ahead", 1, gram))
    sorted_back = members.repartitionByRange(parts, "anchor", "back").sortWithinPartitions("anchor", "back")
    members = members.join(materialize(_back_limits(sorted_back, width, gram), "back_limits"), ["a", "s"])
    sorted_ = members.repartitionByRange(parts, "ahead", "back").sortWithinPartitions("ahead", "back")
    named = materialize(_across(sorted_, width, gram), "across")
    twice = named.filter("h is not null").groupBy("h").agg(F.sum("m").alias("n")).filter("n > 1").select("h")
    across = named.filter("m = 1").join(twice, "h").select("a", "s", "x", "y")
    across = across.unionByName(named.filter("h is null").select("a", "s", "x", "y"))
    whole = kinds.filter("copies > 1").select("a", "s", F.lit(0).alias("x"), F.col("span").cast("int").alias("y"))
    starts = compared.filter("x is not null").unionByName(across).unionByName(whole)
    starts = materialize(starts.groupBy("a", "s").agg(F.collect_set(F.struct("x", "y")).alias("runs")), "starts")
    spread = anchors.join(starts, ["a", "s"]).select("key", "digest", "start", F.explode("runs").alias("run"))
    return spread.select("key", "digest", (F.col("start") + F.col("run.x")).alias("start"), (F.col("start") + F.col("run.y") + 1).alias("stop"))


def dedup_substrings(
    docs: DataFrame, width: int = 400, gram: int = GRAM, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Remove each byte covered by a string of ``width`` bytes that also starts anywhere else.

    Strings lie inside one text, overlap freely, and are judged on the input. Result, one row per
    row of ``docs``: ``key``, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes
    left), kept_sha256, spans (removed runs as start, stop). A null text is empty; repeated rows
    stay, and being copies of each other lose what is long enough; null keys are allowed; other
    columns aren't read; an empty table gives an empty result. ``gram`` is a power of two below
    ``width``. Shuffled are one row per stretch (about 2 / (width - gram) a byte), the texts twice
    (compressed), and one copy of each stretch that shares its anchor with a different one.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    starts = repeated_starts(rows, width, gram).groupBy(F.struct("key", "digest").alias("d"))
    starts = starts.agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    whole = _packed(rows).withColumn("d", F.struct("key", "digest")).join(starts, "d", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for packed, runs in zip(b.column("packed").to_pylist(), b.column("runs").to_pylist()):
                data, spans = _unpack(packed), []
                for r in sorted((r["start"], r["stop"] + width - 1) for r in runs or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1] = spans[-1][0], max(r[1], spans[-1][1])
                    else:
                        spans.append(r)
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                left = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(left), len(spans), left, hashlib.sha256(left).hexdigest(), [list(x) for x in spans]))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", *FIELDS])

    schema = T.StructType().add("key", rows.schema["key"].dataType).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema = schema.add("kept", "binary").add("kept_sha256", "string").add("spans", T.ArrayType(T.ArrayType(T.LongType())))
    return whole.select("key", "packed", "runs").mapInArrow(run, schema).withColumnRenamed("key", key)


FIELDS = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans")
