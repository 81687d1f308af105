"""Readers of raw logs, labelled units, predictions and stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake import config as C
from sentrylake.schemas import EVENT_FIELDS, LABELED, PREDICTION, UNIT_FIELDS


def _named() -> Column:
    """The name of a row's file, or of its folder where Spark wrote the file as a part."""
    file, folder = F.col("_metadata.file_name"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return F.when(file.startswith("part-"), F.regexp_replace(folder, "^run_key=", "")).otherwise(file)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): lines stripped, blank ones dropped.

    line_no rises with the order in each file split; give files with their own
    order column to the parsers directly where exact order across splits matters.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(_named().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return lines.filter(F.length("line") > 0)


def source_of(file_name: Column) -> Column:
    """The log source that a file name stands for: by stem, then by its beginning; else an error."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    exact = beginning = None
    for name, source in C.STEMS.items():
        exact = F.when(stem == name, source) if exact is None else exact.when(stem == name, source)
        beginning = F.when(stem.startswith(name), source) if beginning is None else beginning.when(stem.startswith(name), source)
    return F.coalesce(exact, beginning, F.raise_error(F.concat(F.lit("no log source for file "), file_name)).cast("string"))


def json_records(lines: DataFrame) -> DataFrame:
    """Adds the parsed record's known fields as a struct `event`; lines that are no JSON object go silently."""
    v = F.explode(F.array(F.try_parse_json("line")))  # one row; the filter can't bring the parsing into itself and do it twice
    out = lines.withColumn("_v", v).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    field = lambda f: F.try_variant_get("_v", f"$.{f}", "string").alias(f)
    return out.withColumn("event", F.struct(*[field(f) for f in EVENT_FIELDS])).drop("_v")


def labelled_units(spark: SparkSession, path: str) -> DataFrame:
    """The labelled units; a corrupt line, an unknown field, an empty action, an unknown source or label, or an empty table is an error."""
    lines = spark.read.text(path)
    row = lambda c, kind: F.from_json(c, kind, {"mode": "FAILFAST"})
    parsed = lines.select(row(F.col("value"), LABELED).alias("r"), F.map_keys(F.from_json("value", "map<string,string>")).alias("k"), F.map_keys(F.from_json(F.get_json_object("value", "$.event"), "map<string,string>")).alias("e"))
    known = F.array(*[F.lit(f) for f in ("unit_id", "event", "label", "technique", "rationale")])
    fields = F.array(*[F.lit(f) for f in ("id", *(f for f in UNIT_FIELDS if f != "line_no"))])
    event = F.col("r.event")
    wrong = (
        F.when(F.size(F.array_except("k", known)) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_except("k", known), ", ")))
        .when(F.size(F.array_except("e", fields)) > 0, F.concat(F.lit("unknown field of an event "), F.array_join(F.array_except("e", fields), ", ")))
        .when(F.coalesce(F.trim(event["action"]), F.lit("")) == "", "empty action")
        .when(~F.coalesce(event["source"].isin(*C.SOURCES), F.lit(False)), "unknown source")
        .when(~F.coalesce(F.col("r.label").isin("incident", "benign"), F.lit(False)), "unknown label")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(" in unit "), F.coalesce("r.unit_id", F.lit("?")))).cast("string")).otherwise(F.col("r.unit_id"))
    df = parsed.select(checked.alias("unit_id"), "r.event", "r.label", "r.technique", "r.rationale")
    if df.isEmpty():
        raise ValueError(f"no labelled units in {path}")
    return df


def prediction_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a folder: (run_key, line_no, unit_id, is_incident, technique); the run is the file's stem."""
    df = spark.read.schema(PREDICTION).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    return df.select(F.regexp_extract(_named(), r"^(.*?)(\.[^.]*)?$", 1).alias("run_key"), F.monotonically_increasing_id().alias("line_no"), "unit_id", "is_incident", "technique")


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """(provider, model, prompt_version, key, unit_id, response), partitioned by the first three."""
    return spark.read.parquet(path)
