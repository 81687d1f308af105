"""The store of model responses, bucketed by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "key STRING, unit_id STRING, response STRING, provider STRING, model STRING, prompt_version STRING"


class ResponseStore:
    """Responses under a path that driver and executors share, each key once.

    Rows lie in `buckets` files by a hash of their key (within a folder for each
    provider, model and prompt version), so lookups, misses and appends shuffle the
    prompts they are about and never what is stored. A store keeps its number of
    buckets; choose it so that a bucket fits a task. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"responses_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet PARTITIONED BY (provider, model, prompt_version) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            self._found()

    def _found(self) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """(key, unit_id, response, provider, model, prompt_version); keys are unique."""
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Add the responses whose key isn't stored yet; of several of one key any one."""
        fresh = new.dropDuplicates(["key"])
        fresh = fresh.join(self.rows().select("key"), "key", "left_anti")
        # the bucketed join leaves rows by key already; each task holds one bucket
        fresh = fresh.repartition(self.buckets, "key").select("key", "unit_id", "response", "provider", "model", "prompt_version")
        (fresh.write.mode("append").format("parquet").partitionBy("provider", "model", "prompt_version").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name))
        self._found()
