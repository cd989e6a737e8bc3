"""Small helpers: seconds since the epoch to frames and back."""

from datetime import UTC, datetime

from pyspark.sql import functions as F


def frame(spark, rows, schema):
    """Rows as a DataFrame; a column named ts holds epoch seconds."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("bigint")))


def secs(value):
    return value.replace(tzinfo=UTC).timestamp() if isinstance(value, datetime) else value


def epoch(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.unix_micros(c) / 1e6)
    return df
