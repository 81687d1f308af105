"""Members of the aggregated unit: each record is made once, whatever the number of partitions."""

import contextlib
import io
import json

from pyspark.sql import functions as F

from sentrylake.operators import bursts
from sentrylake.operators.numbering import number_units
from sentrylake.sources.readers import json_records

N = 400


def rows():
    for i in range(N):
        yield i, json.dumps({"timestamp": f"2026-01-10T09:{i // 60:02}:{i % 60:02}+00:00", "action": "console_login", "status": "failure", "username": f"u{i}", "source_ip": f"10.1.0.{i % 250}"})


def test_failures_are_made_once_for_the_one_unit(spark):
    lines = spark.createDataFrame(list(rows()), "line_no long, line string").repartition(4)
    records = json_records(lines)
    units = number_units(bursts.cloud_units(records))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(n):
        seen.add(1)
        return n

    failures = bursts.cloud_failures(records).withColumn("line_no", noted.asNondeterministic()("line_no"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the threshold
    try:
        got = bursts.cloud_members(units, failures).select("unit_id", "place", "line_no", "username").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((m.unit_id, m.place, m.line_no, m.username) for m in got) == [("cld-0001", i + 1, i, f"u{i}") for i in range(N)]
    assert seen.value == N


def test_a_line_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([*rows(), (N, "[1]"), (N + 1, "not json"), (N + 2, None), (N + 3, "{}")], "line_no long, line string").write.parquet(path)
    records = json_records(spark.read.parquet(path))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        records.explain()
    assert plan.getvalue().count("parseJson") == 1
    assert sorted(r.line_no for r in records.collect()) == [*range(N), N + 3]
