"""Correlations: without a cap, spread over time, and for units made elsewhere."""

import json
import random

from pyspark.sql import functions as F

from sentrylake.config import RuleConfig
from sentrylake.operators import bursts, correlate, rules
from sentrylake.plans import detection
from sentrylake.sources.readers import json_records


def lines(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "line_no long, line string")


def failed(i, at="09:00:00"):
    return {"timestamp": f"2026-01-10T{at}+00:00", "action": "console_login", "status": "failure", "username": f"u{i}", "source_ip": f"10.1.{i // 250}.{i % 250}"}


def change(user, ip="10.9.9.9", at="10:00:00"):
    return {"timestamp": f"2026-01-10T{at}+00:00", "action": "iam_policy_changed", "status": "success", "username": user, "source_ip": ip, "target_user": "svc"}


def test_every_failed_login_counts(spark):
    rows = [failed(i) for i in range(1500)] + [change(f"u{i}") for i in (10, 990, 1200, 1400)] + [change("other", "10.1.5.249"), change("other"), change("u7", at="08:00:00"), change("", "")]
    log = lines(spark, rows)
    units = detection.units_of(cloud=log)
    hit = rules.rule_verdicts(units, keep=("target",)).filter("technique = 'T1098'")
    assert hit.count() == 5
    members = bursts.cloud_members(units, bursts.cloud_failures(json_records(log))).collect()
    assert sorted(m.place for m in members) == list(range(1, 1501)) and {m.unit_id for m in members} == {units.filter("action = 'console_login'").first().id}
    assert all(m.place == m.line_no + 1 and m.username == f"u{m.line_no}" for m in members)
    assert units.filter("action = 'console_login'").first().raw["count"] == 1500


def test_members_of_units_by_user(spark):
    log = json_records(lines(spark, [failed(i % 3) | {"source_ip": f"10.0.0.{i}"} for i in range(30)] + [failed(0) | {"username": None}]))
    failures = bursts.cloud_failures(log)
    from sentrylake.operators.numbering import number_units

    units = number_units(bursts.cloud_failure_unit(failures, keys=("username",)))
    n = {r.unit_id: (r.n, r.last) for r in bursts.cloud_members(units, failures, keys=("username",)).groupBy("unit_id").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()}
    assert sorted(n.values()) == [(1, 1)] + [(10, 10)] * 3
    assert {r.id for r in units.collect()} == set(n)


def test_units_made_elsewhere(spark):
    """Units without carried facts: their failures are looked up among the records that they list."""
    log = lines(spark, [failed(1), failed(2), change("u1"), change("u3", "10.1.0.2"), change("u3"), change("u2", at="08:59:59")])
    units = detection.units_of(cloud=log)
    records = [r.event for r in json_records(log).filter("event.action = 'console_login'").collect()]
    listed = spark.createDataFrame([(records,)], units.select("raw.events").schema).first().events
    assert len(listed) == 2
    kind = units.schema["raw"].dataType["events"].dataType.simpleString()
    every = F.from_json(F.lit(json.dumps([r.asDict() for r in records])), kind)
    other = units.withColumn("raw", F.col("raw").withField("facts", F.lit(None).cast("struct<first_failure:timestamp>")).withField("events", F.when(F.col("action") == "console_login", every)))
    got = sorted(r.unit_id for r in rules.rule_verdicts(other).filter("technique = 'T1098'").collect())
    assert got == sorted(r.unit_id for r in rules.rule_verdicts(units).filter("technique = 'T1098'").collect()) and len(got) == 2


def after(rows, minutes):
    for host, at, burst, made, name in rows:
        if made and at is not None:
            yield name, any(b and h == host and t is not None and 0 <= at - t <= minutes * 60_000_000 for h, t, b, _, _ in rows)
        elif made:
            yield name, False


def test_buckets_of_a_timeline(spark):
    r = random.Random(2)
    minute = 60_000_000
    rows = []
    for i in range(600):
        made = r.random() < 0.6
        rows.append((r.choice(["a", "a", "a", None, "b"]), None if i % 97 == 5 else r.randint(0, 900) * minute // 2, not made and r.random() < 0.2, made, i))
    rows += [("x", 0, True, False, 1000), ("x", 60 * minute, False, True, 1001), ("x", 60 * minute + 1, False, True, 1002), ("x", -1, False, True, 1003), ("x", 0, False, True, 1004)]
    df = spark.createDataFrame(rows, "host string, at long, burst boolean, made boolean, name long")
    for minutes in (60, 7, 0):
        got = {x.name: x.after_burst for x in correlate.after_bursts(df, minutes).collect()}
        assert got == dict(after(rows, minutes)), minutes


def test_one_host_spreads_over_tasks(spark):
    df = spark.range(4000).select(F.lit("h").alias("host"), (F.col("id") * 60_000_000).alias("at"), (F.col("id") % 50 == 0).alias("burst"), (F.col("id") % 50 != 0).alias("made"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = correlate.after_bursts(df, 60).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(p["count"] for p in parts) < 0.6 * 3920


def test_one_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "cloud_audit.jsonl").write_text("\n".join(json.dumps(x) for x in (failed(1), change("u1"))) + "\n")
    (tmp_path / "linux_auth.log").write_text("Jan 10 09:00:01 h sshd[1]: Invalid user z from 192.0.2.2 port 1\n")
    read = []
    plain = detection.numbered_lines
    detection.numbered_lines = lambda s, path: read.append(path) or plain(s, path)
    try:
        units, verdicts = detection.detect(spark, str(tmp_path))
    finally:
        detection.numbered_lines = plain
    assert len(read) == 1 and verdicts.filter("technique = 'T1098'").count() == 1
    for df in (units, verdicts):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation [value" not in plan and "text" not in plan


def test_plan_of_cloud_rules(spark):
    """The rules read the numbered units without joining them to themselves; few exchanges."""
    units = detection.units_of(cloud=lines(spark, [failed(1), change("u1")]))
    v = rules.rule_verdicts(units, RuleConfig(), sources=("cloud_audit",), keep=("actor",))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 12 and "NestedLoop" not in plan and "Cartesian" not in plan
