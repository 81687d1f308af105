"""Streams give what the same plan gives in batch."""

import datetime as dt

from pyspark.sql import functions as F

from sentrylake.streaming import alerts


def rows():
    t = dt.datetime(2026, 1, 10, 9, 0)
    out = [("h1", t + dt.timedelta(minutes=i)) for i in range(6)] + [("h2", t + dt.timedelta(minutes=i)) for i in range(2)]
    return out + [("zz", t + dt.timedelta(days=2))]  # moves the watermark past all windows


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_burst_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), "host string, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    cols = ["host", "window_start", "n", "first_ts"]
    got = run(spark, alerts.burst_alerts(stream, "host", "30 minutes", 3, late="10 minutes"), "bursts").select(cols).collect()
    assert got == alerts.burst_alerts(df, "host", "30 minutes", 3).select(cols).collect() and len(got) == 1


def test_account_stream_equals_batch(spark, tmp_path):
    fails = spark.createDataFrame(rows(), "host string, ts timestamp")
    t = dt.datetime(2026, 1, 10, 9, 0)
    made = spark.createDataFrame([("h1", t + dt.timedelta(minutes=m), f"a{m}") for m in (0, 10, 60, 61)] + [("h2", t, "b"), ("zz", t + dt.timedelta(days=3), "c")], "host string, ts timestamp, account string")
    fails.repartition(1).write.parquet(str(tmp_path / "f"))
    made.repartition(1).write.parquet(str(tmp_path / "m"))
    read = lambda d, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / d))
    bursts = alerts.burst_alerts(read("f", fails), "host", "30 minutes", 3, late="10 minutes")
    got = {r.account for r in run(spark, alerts.accounts_after_bursts(bursts, read("m", made), late="10 minutes").select("account"), "made").collect()}
    batch = {r.account for r in alerts.accounts_after_bursts(alerts.burst_alerts(fails, "host", "30 minutes", 3), made).collect()}
    assert got == batch == {"a0", "a10", "a60"}
    assert F is not None
