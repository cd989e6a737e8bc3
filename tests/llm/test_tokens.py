import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contrail.llm.ragged import Memo, PairTable, merge, merge_long
from contrail.llm.sentencepiece_codec import codec, encode, encode_decode
from contrail.llm.token_counts import count_tokens, token_counts

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIB, TOK = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
PARTS = ["a", "B", "é", "ñ", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "​", "1", "²", "٣", "'", "'ll", "!",
         "😀", "日本", "_", "\x00", "▁", "the", "tion", " in", "<s>", "<0x41>", "<|endoftext|>", "﻿"]
EDGES = ["", " ", "  ", "\n", "\n\n", "a\n", " a", "▁", " " * 70, "ab" * 500, "a" * 3000, "\x00", "word " * 5000]
texts = st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=12)


def large(items):
    return pa.array(items, pa.large_string())


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_encoding_is_the_librarys(items):
    assert split(*encode(large(items), PIECES)) == LIB.encode(items, add_bos=True, add_eos=True)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts_are_the_librarys(items):
    assert count_tokens(large(items), BYTES).tolist() == [len(x.ids) for x in TOK.encode_batch(items, add_special_tokens=False)]


def test_edge_texts():
    assert split(*encode(large(EDGES), PIECES)) == LIB.encode(EDGES, add_bos=True, add_eos=True)
    assert count_tokens(large(EDGES), BYTES).tolist() == [len(x.ids) for x in TOK.encode_batch(EDGES, add_special_tokens=False)]


def test_rounds_and_heap_agree():
    table, rnd = codec(PIECES).table, random.Random(5)
    for _ in range(40):
        symbols = codec(PIECES).of_char[[ord(rnd.choice("thein▁ ")) for _ in range(rnd.randint(1, 60))]]
        one, _ = merge(table, symbols.copy(), np.array([len(symbols)]), every=False)
        assert one.tolist() == merge_long(table, symbols).tolist()


def test_pair_table_finds_all_and_nothing_else():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 300, (5000, 2)), axis=0)
    table = PairTable(keys[::2, 0], keys[::2, 1], np.arange(len(keys[::2])), np.arange(len(keys[::2])))
    assert (table.find(keys[::2, 0], keys[::2, 1]) == np.arange(len(keys[::2]))).all()
    assert (table.find(keys[1::2, 0], keys[1::2, 1]) == -1).all()


def test_memo_forgets_in_time():
    memo = Memo(most=3)
    compute = lambda new: (np.concatenate([np.full(len(s), len(s)) for s in new]), np.array([len(s) for s in new]))
    for strings in (["a", "bb"], ["bb", "ccc"], ["a", "dddd", "bb", "ccc"]):
        rows = memo.rows(strings, compute)
        assert memo.counts[rows].tolist() == [len(s) for s in strings]


ROWS = [(1, None), (2, ""), (3, "one two\nthree"), (3, "one two\nthree"), (None, "x  y"), (5, "word " * 9000)]


def test_encode_decode_rows(frame):
    got = encode_decode(frame(ROWS, "doc_id long, text string"), PIECES, ids=True).collect()
    want = []
    for key, text in ROWS:
        ids = LIB.encode(text or "", add_bos=True, add_eos=True)
        back = LIB.decode(ids)
        raw = np.array(ids, "<u4").tobytes()
        want.append((key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back, ids))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_count_rows(frame):
    got = token_counts(frame(ROWS, "doc_id long, text string"), BYTES, limit=3).collect()
    want = [(k, len((t or "").encode()), n := len(TOK.encode(t or "").ids), n > 3) for k, t in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables(frame):
    empty = frame(ROWS, "doc_id long, text string").filter("false")
    assert encode_decode(empty, PIECES).count() == 0 and token_counts(empty, BYTES).count() == 0
