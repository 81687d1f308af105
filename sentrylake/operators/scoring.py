"""Any number of detection runs against labels, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.text import clean_technique

# The known runs, in report order.
RUN_ORDER = ("rules", "llm_v1", "llm_v3", "hybrid")


def last_predictions(predictions: DataFrame) -> DataFrame:
    """Of several rows of a run for one unit the last one, by line_no."""
    w = Window.partitionBy("run_key", "unit_id").orderBy(F.desc("line_no"))
    return predictions.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def judged(labels: DataFrame, predictions: DataFrame, strict: bool = False) -> DataFrame:
    """Each label with each run's prediction; unknown units are ignored, missing predictions are benign and marked.

    strict: missing predictions are an error.
    """
    runs = predictions.agg(F.array_sort(F.collect_set("run_key"))).scalar()
    p = last_predictions(predictions).select("run_key", "unit_id", F.col("is_incident").alias("said"), clean_technique(F.col("technique")).alias("said_technique"), F.lit(True).alias("present"))
    every = labels.select("unit_id", "source", (F.col("label") == "incident").alias("truth"), clean_technique(F.col("technique")).alias("technique"))
    every = every.withColumn("run_key", F.explode(runs))  # a row for each label and run
    out = every.join(p, ["run_key", "unit_id"], "left")
    out = out.withColumn("missing", F.col("present").isNull()).withColumn("said", F.coalesce("said", F.lit(False))).drop("present")
    if strict and not (gone := out.filter("missing")).isEmpty():
        raise ValueError(f"{gone.count()} labelled units have no prediction")
    return out


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fp_per_1000 and technique_accuracy to counts (tp, fp, fn, n_units, _right, _known)."""
    g = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    g = g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    g = g.withColumn("fp_per_1000", ratio(F.col("fp"), F.col("n_units")) * 1000)
    return g.withColumn("technique_accuracy", F.try_divide("_right", "_known")).drop("_right", "_known")


def scores(judged_rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of each run (and of each of `by`)."""
    t, s = F.col("truth"), F.col("said")
    known = t & s & F.col("technique").isNotNull()
    g = judged_rows.groupBy("run_key", *by).agg(
        F.count("*").alias("n_units"), F.count_if(t).alias("n_incidents"), F.count_if(~t).alias("n_benign"), F.count_if(s).alias("n_predicted"), F.count_if("missing").alias("n_missing"),
        F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"),
        F.count_if(known & F.coalesce(F.col("technique") == F.col("said_technique"), F.lit(False))).alias("_right"), F.count_if(known).alias("_known"),
    )
    return rates(g)


def answered(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each run's predictions with the label of their unit: (run_key, source, truth, technique, said, said_technique); those of unknown units have a null truth.

    There is no row for a missing prediction: what is missing follows from the labels' totals.
    """
    truth = labels.select("unit_id", "source", (F.col("label") == "incident").alias("truth"), clean_technique(F.col("technique")).alias("technique"))
    p = predictions.groupBy("run_key", "unit_id").agg(F.max_by(F.struct("is_incident", "technique"), "line_no").alias("p"))  # the last row of a unit
    p = p.select("run_key", "unit_id", F.coalesce("p.is_incident", F.lit(False)).alias("said"), clean_technique(F.col("p.technique")).alias("said_technique"))
    return p.join(truth, "unit_id", "left").drop("unit_id")


def scored(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The rows of scores(judged(labels, predictions)), by one join of the predictions; what runs leave out is subtracted from the labels' totals."""
    t, s = F.coalesce("truth", F.lit(False)), F.col("said")
    known = t & s & F.col("technique").isNotNull()
    total = labels.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "incident").alias("bad"))
    g = answered(labels, predictions).groupBy("run_key").agg(
        F.count("truth").alias("_matched"), F.count_if(t & s).alias("tp"), F.count_if(F.col("truth").isNotNull() & ~t & s).alias("fp"),
        F.count_if(known & F.coalesce(F.col("technique") == F.col("said_technique"), F.lit(False))).alias("_right"), F.count_if(known).alias("_known"),
    )
    n, bad = total.select("n").scalar(), total.select("bad").scalar()
    g = g.select(
        "run_key", n.alias("n_units"), bad.alias("n_incidents"), (n - bad).alias("n_benign"), (F.col("tp") + F.col("fp")).alias("n_predicted"), (n - F.col("_matched")).alias("n_missing"),
        "tp", "fp", (bad - F.col("tp")).alias("fn"), (n - bad - F.col("fp")).alias("tn"), "_right", "_known",
    )
    return rates(g)


def missing_predictions(labels: DataFrame, predictions: DataFrame, run_key: str) -> DataFrame:
    """(unit_id): the labelled units that a run has no prediction for."""
    return labels.select("unit_id").join(predictions.filter(F.col("run_key") == run_key).select("unit_id"), "unit_id", "left_anti")


def errors(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """The rows of error_counts(judged(labels, predictions)): false alarms by source, and each technique's incidents less those that a run caught."""
    hits = answered(labels, predictions)
    t = F.coalesce("truth", F.lit(False))
    technique = F.coalesce("technique", F.lit("unspecified"))
    alarms = hits.filter(F.col("truth").isNotNull() & ~t & F.col("said")).groupBy("run_key", F.lit("fp").alias("kind"), F.col("source").alias("name")).agg(F.count("*").alias("n"))
    caught = hits.groupBy("run_key", technique.alias("name")).agg(F.count_if(t & F.col("said")).alias("_caught"))
    every = labels.filter("label = 'incident'").groupBy(F.coalesce(clean_technique(F.col("technique")), F.lit("unspecified")).alias("name")).agg(F.count("*").alias("all"))
    listed = every.agg(F.collect_list(F.struct("name", "all"))).scalar()  # as long as the catalogue of techniques
    wanted = hits.select("run_key").distinct().select("run_key", F.explode(listed).alias("e")).select("run_key", "e.name", "e.all")
    missed = wanted.join(caught, ["run_key", "name"], "left").select("run_key", F.lit("fn").alias("kind"), "name", (F.col("all") - F.coalesce("_caught", F.lit(0))).alias("n"))
    return alarms.unionByName(missed.filter("n > 0"))


def summary(scored: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded scores with their place in the report: known runs in order, then the others by name."""
    place = F.lit(999)
    for i, name in enumerate(RUN_ORDER):
        place = F.when(F.col("run_key") == name, i).otherwise(place)
    rounded = {c: F.bround(c, 2 if c == "fp_per_1000" else digits) for c in ("precision", "recall", "f1", "fp_per_1000", "technique_accuracy")}
    return scored.withColumns(rounded).withColumn("place", place).orderBy("place", "run_key")


def f1_matrix(scored: DataFrame, models: DataFrame, versions: list[str], baseline: str = "rules") -> DataFrame:
    """F1 of each model by prompt version; the baseline run fills every column of its row. models: run_key, model, version."""
    cells = scored.join(models, "run_key").groupBy("model").pivot("version", versions).agg(F.first("f1"))
    base = scored.filter(F.col("run_key") == baseline).select(F.lit(baseline).alias("model"), *[F.col("f1").alias(v) for v in versions])
    return base.unionByName(cells)


def error_counts(judged_rows: DataFrame) -> DataFrame:
    """(run_key, kind, name, n): false alarms by source, misses by technique."""
    wrong = judged_rows.filter("truth <> said")
    name = F.when(F.col("said"), F.col("source")).otherwise(F.coalesce("technique", F.lit("unspecified")))
    return wrong.groupBy("run_key", F.when(F.col("said"), "fp").otherwise("fn").alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))


def top_errors(counts: DataFrame, k: int = 3) -> DataFrame:
    """(run_key, kind, top): the k most frequent names, as text."""
    w = Window.partitionBy("run_key", "kind").orderBy(F.desc("n"), "name")
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    text = F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"])
    return top.groupBy("run_key", "kind").agg(F.array_join(listed, ", ").alias("top"))


def drift(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """Units in which two runs differ, or that only one has; empty if the runs agree."""
    a = produced.select("unit_id", F.col("is_incident").alias("now"), F.col("technique").alias("now_technique"), F.lit(True).alias("in_now"))
    b = stored.select("unit_id", F.col("is_incident").alias("then"), F.col("technique").alias("then_technique"), F.lit(True).alias("in_then"))
    same = F.col("now").eqNullSafe(F.col("then")) & F.col("now_technique").eqNullSafe(F.col("then_technique")) & F.col("in_now").eqNullSafe(F.col("in_then"))
    return a.join(b, "unit_id", "full_outer").filter(~same)


def unit_counts(labelled: DataFrame) -> DataFrame:
    """Units, incidents, benign and share by source, with a total row (source null)."""
    g = labelled.rollup("source").agg(F.count("*").alias("units"), F.count_if(F.col("label") == "incident").alias("incidents"))
    return g.withColumn("benign", F.col("units") - F.col("incidents")).withColumn("share", ratio(F.col("incidents"), F.col("units")))
