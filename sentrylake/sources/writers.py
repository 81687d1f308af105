"""Writers of predictions, corpora, responses and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_predictions(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One prediction for each labelled unit, benign where the detector gave none."""
    v = verdicts.select("unit_id", "is_incident", "technique")
    return labels.select("unit_id").join(v, "unit_id", "left").select("unit_id", F.coalesce("is_incident", F.lit(False)).alias("is_incident"), "technique")


def write_predictions(labels: DataFrame, verdicts: DataFrame, run_key: str, path: str) -> None:
    complete_predictions(labels, verdicts).withColumn("run_key", F.lit(run_key)).write.mode("overwrite").partitionBy("run_key").json(path)


def write_corpus(labelled: DataFrame, path: str) -> None:
    labelled.write.mode("overwrite").json(path)


def append_responses(known: DataFrame | None, new: DataFrame, path: str) -> None:
    """Append the responses whose key isn't stored yet."""
    fresh = new.dropDuplicates(["key"]) if known is None else new.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    fresh.write.mode("append").partitionBy("provider", "model", "prompt_version").parquet(path)


def write_report(table: DataFrame, path: str) -> None:
    """The same table as CSV with a header and as JSON."""
    table.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    table.write.mode("overwrite").json(f"{path}/json")


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").json(path)
