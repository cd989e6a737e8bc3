"""A training corpus from documents: language, repeated lines, near copies, test passages, tokens."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.decontaminate import decontaminate
from contrail.llm.language_id import UNKNOWN, language_id
from contrail.llm.line_dedup import dedup_lines
from contrail.llm.sentencepiece_codec import encode_decode
from contrail.llm.set_join import similar_documents
from contrail.sources.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_ROWS = "2000"  # whole documents travel to Python in batches of so many


def small_batches(stage):
    """The stage with Arrow batches of few documents: memory beside the heap follows them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id(docs, carry=COLUMNS).filter(F.col("lang_pred") != UNKNOWN).select("carried.*")


@small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more go; a document that loses every line goes."""
    found = dedup_lines(docs, least=50, carry=("lang", "source", "n_chars"))
    found = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carried.n_chars"))
    return found.select("doc_id", "text", "carried.lang", "carried.source", n_chars.alias("n_chars"))


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the one of the smallest id.

    Documents go by id and text, so repeated ids, null ids (the last ones) and repeated rows have copies like others."""
    name = F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("digest"))
    named = docs.select(*COLUMNS, name.alias("name"))
    gone = similar_documents(named, width=5, similarity=0.8, key="name").filter("component_id <> name").select("name").distinct()
    twice = named.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name")
    marks = gone.withColumn("gone", F.lit(True)).join(twice.withColumn("twice", F.lit(True)), "name", "full")
    left = named.join(marks, "name", "left").filter("gone IS NULL")
    return left.filter("twice IS NULL").select(*COLUMNS).union(left.filter("twice").dropDuplicates(["name"]).select(*COLUMNS))


@small_batches
def test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of 13 words of test items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, carry=COLUMNS).filter(~F.col("contaminated")).select("carried.*")


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their round trip."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", test_passages),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None  # language identification and the tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written and read again as the documents of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
