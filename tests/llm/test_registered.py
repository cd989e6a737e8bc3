"""Registered queries without SQL, by value, over the whole small tables; and workers that lack the package."""

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from contrail.llm import catalog

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def docs():
    rows = duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    return {k: (t or "", lang) for k, t, lang in rows}


def result(spark, name):
    return {r.doc_id: r for r in catalog.queries()[name](spark, SF).collect()}


def test_sentencepiece_and_token_counts(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    count = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, counts = result(spark, "op2_sentencepiece"), result(spark, "op3_token_counts")
    assert set(pieces) == set(counts) == set(docs)
    for k, (text, _) in docs.items():
        ids = lib.encode(text, add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (pieces[k].n_tokens, pieces[k].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert pieces[k].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        n = len(count.encode(text, add_special_tokens=False).ids)
        assert (counts[k].n_bytes, counts[k].n_tokens, counts[k].over_limit) == (len(text.encode()), n, n > 512)


def test_suffix_dedup(spark, docs):
    starts = Counter(raw[i : i + 400] for raw in (t.encode() for t, _ in docs.values()) for i in range(len(raw) - 399))
    got = result(spark, "op4_suffix_dedup")
    for k, (text, _) in docs.items():
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if starts[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (len(raw), len(raw) - len(kept), spans)
        assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()
        if not spans:
            assert got[k].text == text


def test_simhash(spark, docs):
    prints = {}
    for k, (text, _) in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = result(spark, "op8_simhash")
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{f:016x}", find(k)) for k, f in prints.items()}


def test_language(spark, docs):
    got, right = result(spark, "op10_language_id"), defaultdict(list)
    assert set(got) == set(docs)
    for k, (_, lang) in docs.items():
        if got[k].held_out and lang and got[k].lang_pred != "und":
            right[lang].append(got[k].lang_pred == lang)
    assert right and all(sum(v) >= 0.95 * len(v) for v in right.values())


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from contrail.llm import catalog
for name in ("op2_sentencepiece", "op7_decontaminate", "op8_simhash", "op10_language_id", "op12_collocations"):
    assert catalog.queries()[name](spark, {sf!r}).count(), name
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
