"""From a folder of raw logs to numbered units and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.config import SOURCES, RuleConfig, ShapeConfig
from sentrylake.operators.bursts import access_units, auth_units, cloud_units, windows_units
from sentrylake.operators.numbering import number_units
from sentrylake.operators.parse import access_records, auth_records
from sentrylake.operators.rules import rule_verdicts
from sentrylake.sources.readers import json_records, numbered_lines, source_of
from sentrylake.sources.scratch import scratch_path


def units_of(auth: DataFrame | None = None, access: DataFrame | None = None, windows: DataFrame | None = None, cloud: DataFrame | None = None, year: int = 2026, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Numbered units of line tables (line, line_no)."""
    parts = []
    if auth is not None:
        parts.append(auth_units(auth_records(auth, year), shape))
    if access is not None:
        parts.append(access_units(access_records(access), shape))
    if windows is not None:
        parts.append(windows_units(json_records(windows), shape))
    if cloud is not None:
        parts.append(cloud_units(json_records(cloud), shape))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return number_units(out)


def routed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lines of every log in a folder, by source.

    One pass over the files writes them into a table that is partitioned by source;
    each source is read back from its own partition.
    """
    lines = numbered_lines(spark, folder)
    table = scratch_path(spark, "lines")
    lines.withColumn("source", source_of(lines["file"])).write.partitionBy("source").parquet(table)
    every = spark.read.schema("file string, line_no long, line string, source string").parquet(table)
    return {s: every.filter(F.col("source") == s) for s in SOURCES}


def units_in(spark: SparkSession, folder: str, year: int = 2026, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Numbered units of every log in a folder; both access logs are one source."""
    own = routed(spark, folder)
    return units_of(own["linux_auth"], own["nginx_access"], own["windows_security"], own["cloud_audit"], year, shape)


def detect(spark: SparkSession, folder: str, rules: RuleConfig = RuleConfig(), year: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(units, rule verdicts) of a folder."""
    units = units_in(spark, folder, year)
    return units, rule_verdicts(units, rules)
