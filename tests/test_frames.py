"""All declared rules in one stream, against batch and plain counting."""

import datetime as dt
import random
from collections import Counter

from sentrylake.streaming import alerts

T0 = dt.datetime(2026, 1, 10, 9, 0, tzinfo=dt.timezone.utc)
KIND = "rule string, key string, ts timestamp"


def events(n=6000):
    r = random.Random(8)
    out = [(r.choice([*alerts.FRAMES, "undeclared"]), r.choice(["a", "b", None]), T0 + dt.timedelta(seconds=r.randint(0, 3600))) for _ in range(n)]
    return out + [("ssh", "a", None)] + [("ssh", "edge", T0 + dt.timedelta(seconds=s)) for s in [0] * 6 + [599] * 5 + [600] * 10]


def expected(rows):
    n, first = Counter(), {}
    for rule, key, ts in rows:
        if rule in alerts.FRAMES and ts is not None:
            w = alerts.FRAMES[rule].minutes * 60
            start = int(ts.timestamp()) // w * w
            n[rule, key, start, start + w] += 1
            first[rule, key, start, start + w] = min(first.get((rule, key, start, start + w), ts), ts)
    return [(*k, c, int(first[k].timestamp())) for k, c in n.items() if c > alerts.FRAMES[k[0]].more_than]


def plain(df):
    rows = df.selectExpr("rule", "key", "unix_timestamp(window_start) as s", "unix_timestamp(window_end) as e", "n", "unix_timestamp(first_ts) as f").collect()
    return sorted((tuple(r) for r in rows), key=str)


def run(spark, batches, tmp_path, name, late):
    """A file a batch; the last moves the watermark past all windows."""
    folder = str(tmp_path / name)
    for rows in [*batches, [("ssh", "zz", T0 + dt.timedelta(days=2))]]:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)
    q = alerts.declared_alerts(stream, late=late).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    counts = alerts.late_rows(q)
    q.stop()
    return spark.table(name), counts


def test_batch(spark):
    rows = events()
    got = plain(alerts.declared_alerts(spark.createDataFrame(rows, KIND)))
    assert got == sorted(expected(rows), key=str) and {g[0] for g in got} == set(alerts.FRAMES)


def test_stream_equals_batch(spark, tmp_path):
    rows = events()
    got, counts = run(spark, [rows[i::3] for i in range(3)], tmp_path, "frames", "2 hours")
    assert plain(got) == sorted(expected(rows), key=str)
    used = [r for r in rows if r[0] in alerts.FRAMES and r[2] is not None]
    assert counts["dropped"] == 0 and counts["read"] == counts["used"] == len(rows) + 1 and len(used) < len(rows)


def test_late_rows_are_counted(spark, tmp_path):
    """Rows behind the watermark don't alert, and rows used and dropped add up to those read."""
    on_time = [("ssh", "a", T0 + dt.timedelta(seconds=i)) for i in range(12)] + [("windows", "h", T0 + dt.timedelta(hours=5, seconds=i)) for i in range(288)]
    late = [("ssh", "a", T0 + dt.timedelta(seconds=20))] * 7 + [("ssh", "b", T0 + dt.timedelta(minutes=1))] * 13
    last = [("ssh", "c", T0 + dt.timedelta(hours=6))]  # a batch by which the watermark of the first takes hold
    got, counts = run(spark, [on_time, last, late], tmp_path, "late", "10 minutes")
    assert counts == {"read": len(on_time + late) + 2, "used": len(on_time) + 2, "dropped": len(late)}
    assert plain(got) == sorted(expected(on_time), key=str)
