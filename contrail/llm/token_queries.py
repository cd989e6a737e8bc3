"""Queries on tokens: SentencePiece round trip and byte-level token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contrail.llm.sentencepiece_codec import encode_decode
from contrail.llm.token_counts import token_counts


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece, "op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
