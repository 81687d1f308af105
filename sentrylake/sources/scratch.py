"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("SENTRYLAKE_SCRATCH")
    if not base:
        base = os.environ["SENTRYLAKE_SCRATCH"] = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back: what follows reads columns and doesn't do the work again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
