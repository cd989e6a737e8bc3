import random

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from compare import compare, connect

from contrail.llm import catalog

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"
STEPS = [f for _, f in corpus_pipeline.STAGES]


def passage(rnd, words):
    return " ".join("".join(rnd.choice(["the", "ing", "ou", "re", "sh", "an", "ti"]) for _ in range(rnd.randint(2, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    item, shared = passage(rnd, 40), passage(rnd, 70)
    texts = {i: "\n".join(passage(rnd, 30) for _ in range(6)) for i in range(40)}
    texts[50] = texts[1]  # a copy
    near = texts[2].split(" ")
    near[80] = "edited"
    texts[51] = " ".join(near).replace("\n", " ")  # near copy without a common line
    texts[52], texts[53] = (passage(rnd, 300) + "\n" + shared for _ in range(2))  # a shared passage
    texts[54] = passage(rnd, 30) + " " + item  # test passage
    texts[55] = passage(rnd, 900) + " " + " ".join(item.split()[:13])  # too little of it
    texts |= {56: None, 57: "", 58: "12 34 !", 59: "a\n" * 5000}
    rows = [(k, t, "en" if k < 40 else None, "s", len(t or ""), "e") for k, t in texts.items()] + [(None, passage(rnd, 20), None, None, None, None)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for step in STEPS[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf_dir).collect(), DOC.rsplit(",", 1)[0])
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    language, line, near, clean = kept
    assert set(before) - set(language) == {56, 57, 58}
    assert all(language[k].text == before[k] for k in language)
    assert set(language) - set(line) == {50} and line[52].text == before[52]
    assert line[53].text == before[53].split("\n")[0] and line[53].n_chars == len(line[53].text)
    assert set(line) - set(near) == {51}
    assert set(near) - set(clean) == {54}


def test_run(spark, sf_dir):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got[5] == len(lib.encode(text[5])) + 2 and None in got and 54 not in got and 50 not in got


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for step in STEPS:
        assert step(spark, docs, sf_dir).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    rnd = random.Random(12)
    a, b, c = (passage(rnd, 120) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, b + " end"), (None, c), (None, "alone")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "e") for k, t in rows], DOC).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (None, "alone")], key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = connect("/root/testdata/sf0.001")
    assert compare(spark, con, "/root/testdata/sf0.001", catalog.queries()[name], catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_give_a_row_for_each_document(spark, name):
    con = duckdb.connect()
    want = con.execute("SELECT count(*) FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()[0][0]
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() == want
