"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library.

Merging pops the best-scored adjacent pair (leftmost first among equals) of a sequence until no
pair is a piece. Segments of a batch pop together from agendas held as ragged arrays; a long
segment has a heap of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from contrail.llm.batches import chunks, large_text, once, spread
from contrail.llm.ragged import Memo, PairTable, merge, merge_long

SPACE = "\u2581"  # Fixed value: the library's mark for a blank.
LONG = 64  # longer segments are merged by a heap instead of in rounds
NORMAL, UNKNOWN, USER_DEFINED, BYTE, UNUSED = 1, 2, 4, 6, 5  # Fixed values: piece types of the model format.


@dataclass
class Codec:
    processor: sentencepiece.SentencePieceProcessor
    table: PairTable
    of_char: np.ndarray  # piece of each character, -1 where there is none
    bytes_of: np.ndarray  # piece of each byte
    bos: int
    eos: int


@once
def codec(path: str) -> Codec:
    """Load a model file; models that normalize text or aren't of the merge type are refused."""
    model = model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    train, norm = model.trainer_spec, model.normalizer_spec
    supported = (
        train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix
        and norm.escape_whitespaces
    )
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if not supported or any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces) or any(
        SPACE in p.lstrip(SPACE) or "\n" in p for p in ids
    ):
        raise ValueError(f"{path}: only merge-type models with byte fallback and no normalization are supported")
    rank_of = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in ids.values()}, reverse=True))}
    left, right, rank, merged = [], [], [], []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            if piece[:k] in ids and piece[k:] in ids:
                left.append(ids[piece[:k]])
                right.append(ids[piece[k:]])
                rank.append(rank_of[model.pieces[i].score])
                merged.append(i)
    of_char = np.full(0x110000, -1, np.int64)
    for piece, i in ids.items():
        if len(piece) == 1:
            of_char[ord(piece)] = i
    bytes_of = np.zeros(256, np.int64)
    for i, p in enumerate(model.pieces):
        if p.type == BYTE:
            bytes_of[int(p.piece[3:5], 16)] = i
    processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    return Codec(processor, PairTable(left, right, rank, merged), of_char, bytes_of, processor.bos_id(), processor.eos_id())


def encode_segments(c: Codec, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each segment (text in which SPACE stands for a blank), flat, and their count by segment."""
    chars = np.frombuffer("".join(segments.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = c.of_char[chars]
    lost = symbols < 0
    symbols[lost] = -1 - chars[lost]  # negative: never merges, becomes bytes at the end
    starts = np.cumsum(lengths) - lengths
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        keep = np.repeat(lengths <= LONG, lengths)
        short_ids, short_n = merge(c.table, symbols[keep], lengths[lengths <= LONG], every=False)
        counts = np.zeros(len(lengths), np.int64)
        counts[lengths <= LONG] = short_n
        parts = [merge_long(c.table, symbols[starts[i] : starts[i] + lengths[i]]) for i in long]
        counts[long] = [len(p) for p in parts]
        at = np.cumsum(counts) - counts
        ids = np.empty(counts.sum(), np.int64)
        ids[spread(at[lengths <= LONG], short_n)] = short_ids
        for i, p in zip(long, parts):
            ids[at[i] : at[i] + len(p)] = p
    else:
        ids, counts = merge(c.table, symbols, lengths, every=False)
    if not lost.any():
        return ids, counts
    seg = np.repeat(np.arange(len(counts)), counts)
    char = np.where(ids < 0, -1 - ids, 0)
    width = np.where(ids >= 0, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
    out = np.repeat(ids, width)
    raw = "".join(map(chr, char[ids < 0].tolist())).encode()
    out[np.repeat(ids < 0, width)] = c.bytes_of[np.frombuffer(raw, np.uint8)]
    return out, np.bincount(seg, width, len(counts)).astype(np.int64)


def _check(c: Codec, segments: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
    """Compare with the library, all segments in one text; raises at a difference."""
    theirs = c.processor.encode("\n" + "\n".join(segments.to_pylist()), num_threads=1)
    head = c.processor.encode("\n")  # behind a line end the library adds no blank
    total = counts + 1
    want, inner = np.full(total.sum(), head[-1]), np.ones(total.sum(), bool)
    inner[np.cumsum(total) - total] = False
    want[inner] = ids
    if theirs[: len(head) - 1] != head[:-1] or not np.array_equal(np.array(theirs[len(head) - 1 :]), want):
        raise ValueError("the encoding differs from the sentencepiece library's")


def _segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the marked texts that no vocabulary piece crosses, flat, and their count by text."""
    odd = pc.match_substring_regex(texts, f"^$|^ |  |[\x00{SPACE}]").to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd))
    large = pa.large_string()
    plain = pc.binary_join_element_wise(pa.scalar(SPACE, large), plain, pa.scalar("", large))
    marked = pc.replace_substring(plain, " ", "\0" + SPACE)
    marked = pc.replace_substring(marked, "\n", "\0\n\0")
    parts = pc.split_pattern(marked, "\0")
    flat = parts.flatten()
    sizes = np.zeros(len(texts), np.int64)
    sizes[~odd] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    if not odd.any():
        return flat, sizes
    find = regex.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
    more = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    sizes[odd] = [len(x) for x in more]
    values = pa.concat_arrays([flat, pa.array([s for x in more for s in x], large)])
    first = np.zeros(len(texts), np.int64)
    first[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
    first[odd] = len(flat) + np.cumsum(sizes[odd]) - sizes[odd]
    return values.take(pa.array(spread(first, sizes))), sizes


@once
def _memo(path: str, checked: bool) -> Memo:
    return Memo()


def encode(texts: pa.Array, path: str, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (large_string, no null) with begin and end ids, flat, and their count by text.

    Each different segment is merged once, and with ``check`` compared with the library; a worker
    remembers a bounded number of them.
    """
    c, memo = codec(path), _memo(path, check)

    def compute(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        segments = pa.array(new, pa.large_string())
        ids, counts = encode_segments(c, segments)
        if check:
            _check(c, segments, ids, counts)
        return ids, counts

    flat, sizes = _segments(texts)
    coded = flat.dictionary_encode()
    which = memo.rows(coded.dictionary.to_pylist(), compute)[coded.indices.to_numpy()]
    n = memo.counts[which]
    body = memo.flat[spread(memo.starts[which], n)]
    sums, ends = np.r_[0, np.cumsum(n)], np.cumsum(sizes)
    inner = sums[ends] - sums[ends - sizes]
    # the empty text has no segment: the library adds no blank to it
    total = inner + 2
    out, inside = np.empty(total.sum(), np.int32), np.ones(total.sum(), bool)
    ends = np.cumsum(total)
    out[ends - total], out[ends - 1] = c.bos, c.eos
    inside[ends - total] = inside[ends - 1] = False
    out[inside] = body
    return out, total


def encode_decode(
    docs: DataFrame, path: str, check: bool = True, ids: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every whole text with begin and end ids and decode it again.

    One row per row of ``docs``: ``key``, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256 (UTF-8), decoded, and ``ids`` as an array if asked for. No
    shuffle. A null text counts as empty, which has the begin and end ids only; repeated rows and
    null keys stay; other columns are not read; an empty table gives an empty result. A long text
    is a chunk of its own. With ``check``, every different segment of a chunk is also encoded by
    the library; a difference raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).processor.decode
        for part in chunks(batches):
            found, n = encode(large_text(part.column("text")), path, check)
            ends = np.cumsum(n)
            small = found.astype("<u4")
            decoded = decode([x.tolist() for x in np.split(found, ends[:-1])], num_threads=1)
            columns = [
                part.column("key"),
                pa.array(n),
                pa.array([hashlib.sha256(small[e - k : e]).hexdigest() for k, e in zip(n.tolist(), ends.tolist())]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                pa.array(decoded, pa.string()),
            ]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
            if ids:
                columns.append(pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), small.astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = T.StructType().add("key", rows.schema["key"].dataType).add("n_tokens", "long")
    for name in ("ids_sha256", "decoded_sha256", "decoded"):
        schema = schema.add(name, "string")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
