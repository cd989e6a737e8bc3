"""Aircraft registry file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail import schema


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV files with a single quote as quote character, plus ``line_no``, which orders lines by file and place.

    Inside one block of a file lines are read in order, and blocks are ordered by where they start,
    so the order does not depend on how files are split or dealt.
    """
    place = ("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return (
        spark.read.schema(schema.REGISTRY)
        .option("quote", "'")
        .csv(path)
        .withColumn("line_no", F.struct(*place))
    )
