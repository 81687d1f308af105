"""Rules first; what they leave goes to the second arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_to_judge(units: DataFrame, rules: DataFrame) -> DataFrame:
    """The units that the rules don't call incidents."""
    return units.join(rules.filter("is_incident").select(F.col("unit_id").alias("id")), "id", "left_anti")


def combined(rules: DataFrame, second: DataFrame, tag: bool = True) -> DataFrame:
    """The rules' row where it is an incident, else the second arm's (benign if it has none), with the arm named in the reason."""
    s = second.select("unit_id", *[F.col(c).alias(f"s_{c}") for c in ("is_incident", "technique", "confidence", "reason")])
    own = F.col("is_incident")
    reason = lambda name, c: F.concat_ws(" ", F.lit(name if tag else None), F.nullif(F.trim(c), F.lit("")))
    return rules.join(s, "unit_id", "left").select(
        "unit_id",
        F.when(own, own).otherwise(F.coalesce("s_is_incident", F.lit(False))).alias("is_incident"),
        F.when(own, F.col("technique")).otherwise(F.col("s_technique")).alias("technique"),
        F.when(own, F.col("confidence")).otherwise(F.col("s_confidence")).alias("confidence"),
        F.when(own, reason("[hybrid:rules]", F.col("reason"))).otherwise(reason("[hybrid:llm]", F.col("s_reason"))).alias("reason"),
    )
