"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contrail.llm.batches import chunks, flat_bytes, large_text, once
from contrail.llm.ragged import Memo, PairTable, merge

# The published split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EMPTY = np.zeros(0, np.int32)
FIND = regex.compile(SPLIT).findall
ASCII_FIND = re.compile(
    SPLIT.replace(r"?\p{L}+", "?[A-Za-z]+").replace(r"?\p{N}+", "?[0-9]+").replace(r"\p{L}\p{N}", "A-Za-z0-9"), re.A
).findall
# Two blanks together, other white space, or the mark at which texts are cut.
ODD = r"[ \n]{2}|[\x00\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else free))
        free += byte not in printable
    return letters


@once
def _vocabulary(path: str) -> tuple[PairTable, np.ndarray, regex.Pattern | None]:
    """Pair table, the symbol of each byte, and a pattern of the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
    plain = plain and split.get("use_regex", True) and not spec["normalizer"] and not model.get("ignore_merges")
    strict = ("single_word", "lstrip", "rstrip")
    if not plain or any(x[k] for x in spec["added_tokens"] for k in strict):
        raise ValueError(f"{path}: only plain byte-level BPE files are supported")
    ids = model["vocab"]
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    table = PairTable(
        [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], range(len(pairs)), [ids[a + b] for a, b in pairs]
    )
    special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
    found = regex.compile("|".join(map(regex.escape, special))) if special else None
    return table, np.array([ids[x] for x in _byte_letters()], np.int64), found


@once
def _memo(path: str) -> Memo:
    return Memo()


def _merged(pieces: list[str], table: PairTable, of_byte: np.ndarray) -> np.ndarray:
    """Symbols left of each pre-token; each different one is merged once."""
    coded = pa.array(pieces, pa.large_string()).dictionary_encode()
    lengths = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)
    data, _ = flat_bytes(coded.dictionary)
    _, counts = merge(table, of_byte[data], lengths, every=True)
    return counts[coded.indices.to_numpy()]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums, ends = np.r_[0, np.cumsum(values)], np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _count_each(texts: list[str], table: PairTable, of_byte: np.ndarray, special: regex.Pattern | None) -> np.ndarray:
    pieces, sizes, extra = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before, find = len(pieces), ASCII_FIND if text.isascii() else FIND
        if special is not None and special.search(text):
            parts = special.split(text)
            extra[i] = len(parts) - 1
            for part in parts:
                pieces += find(part)
        else:
            pieces += find(text)
        sizes[i] = len(pieces) - before
    return extra + _sums(_merged(pieces, table, of_byte), sizes) if pieces else extra


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a large_string array.

    Where all white space is single blanks and line ends, pre-tokens cannot cross them, so the
    text is cut there and each different piece of the array is counted once.
    """
    table, of_byte, special = _vocabulary(path)
    odd = pc.match_substring_regex(texts, ODD)
    if special is not None:
        odd = pc.or_(odd, pc.match_substring_regex(texts, special.pattern))
    odd = odd.to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    if odd.any():
        out[odd] = _count_each(texts.filter(pa.array(odd)).to_pylist(), table, of_byte, special)
    if not odd.all():
        plain = texts.filter(pa.array(~odd))
        plain = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        parts = pc.split_pattern(plain, "\0")
        coded = parts.flatten().dictionary_encode()
        memo = _memo(path)
        rows = memo.rows(coded.dictionary.to_pylist(), lambda new: (EMPTY, _count_each(new, table, of_byte, None)))
        each = memo.counts[rows]
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        out[~odd] = _sums(each[coded.indices.to_numpy()], sizes)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the ``tokenizers`` file at ``path`` over the whole text, without added
    tokens; its special strings inside a text count as one token each. No shuffle. A null or
    empty text has 0 tokens; repeated rows stay; a null key is kept; other columns are not read;
    an empty table gives an empty result. A long text is handled as a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = large_text(part.column("text"))
            tokens = count_tokens(texts, path)
            sizes = pc.binary_length(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), sizes.cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = (
        T.StructType()
        .add("key", rows.schema["key"].dataType)
        .add("n_bytes", "long")
        .add("n_tokens", "long")
        .add("over_limit", "boolean")
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
