"""Where two arms disagree, and a spread of examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.text import first_sentence, raw_snippet

CLASSES = ("rules_miss", "false_alarm", "second_miss")


def classified(labelled: DataFrame, rules: DataFrame, second: DataFrame) -> DataFrame:
    """Labelled units with both arms' flags and the class of their disagreement, if any.

    rules_miss: an incident that only the second arm saw; false_alarm: a benign unit
    that only the second arm called; second_miss: an incident that only the rules saw.
    """
    flag = lambda df, name: df.select("unit_id", F.col("is_incident").alias(name))
    out = labelled.join(flag(rules, "by_rules"), "unit_id", "left").join(flag(second, "by_second"), "unit_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("by_rules", "by_second")})
    bad, r, s = F.col("label") == "incident", F.col("by_rules"), F.col("by_second")
    return out.withColumn("class", F.when(bad & ~r & s, "rules_miss").when(~bad & s & ~r, "false_alarm").when(bad & r & ~s, "second_miss"))


def diverse(candidates: DataFrame, k: int, *by: str) -> DataFrame:
    """k rows (of each of `by`): the first of every source, then the rest, by source and unit."""
    first = Window.partitionBy(*by, "source").orderBy("unit_id")
    pick = Window.partitionBy(*by).orderBy("_later", "source", "unit_id")
    out = candidates.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k).withColumn("_later", F.col("_rn") > 1)
    return out.withColumn("pick", F.row_number().over(pick)).filter(F.col("pick") <= k).drop("_rn", "_later")


def example_sets(labelled: DataFrame, rules: DataFrame, second: DataFrame, k: int = 3) -> DataFrame:
    """Examples: k where the second arm helps, and k where it misfires (false alarms first, then misses)."""
    c = classified(labelled, rules, second).filter("class is not null").withColumn("source", F.col("event.source"))
    best = diverse(c, k, "class")
    sets = best.withColumn("set", F.when(F.col("class") == "rules_miss", "helps").otherwise("misfires"))
    w = Window.partitionBy("set").orderBy(F.col("class") != "false_alarm", "pick")
    return sets.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(
        "set", "place", "class", "unit_id", "source", F.col("label").alias("truth"), "technique", F.col("event.action").alias("action"), F.col("event.actor").alias("actor"),
        F.col("by_rules").alias("rules_is_incident"), F.col("by_second").alias("llm_is_incident"), first_sentence(F.col("rationale")).alias("why"), raw_snippet(F.col("event.raw")).alias("raw"),
    )


def first_units(units: DataFrame, n: int) -> DataFrame:
    return units.orderBy("id").limit(n)
