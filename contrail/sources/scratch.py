"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="contrail-")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where that is unset a local session gets a new
    one; a cluster is refused, because its machines don't see each other's folders."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder that all machines share")
    return (folder or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/contrail/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one costly result feeds several branches. Unlike a cached frame it survives the
    loss of an executor, and readers still prune columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
