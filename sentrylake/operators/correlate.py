"""Correlations over the whole batch: an event that follows another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.text import filled, iso_time


def windows_field(raw: Column, name: str) -> Column:
    """A Windows field of a burst's or of a single record's raw struct."""
    return F.coalesce(raw[name], raw["event"][name]) if name in ("event_code", "host") else raw["event"][name]


def after_bursts(rows: DataFrame, minutes: int) -> DataFrame:
    """Of rows (host, at in microseconds, burst, made, ...) those made, with after_burst: a burst on the same host came at most `minutes` before, or just then.

    Each host's timeline is cut into buckets of that many minutes, so a busy host is many
    groups. A burst that counts lies in the same bucket, earlier, or is the last of the
    bucket before, which is carried over as a row of its own. Missing hosts are one
    host; rows without a time follow nothing.
    """
    width = minutes * 60_000_000
    line = rows.filter((F.col("burst") | F.col("made")) & F.col("at").isNotNull()).withColumn("_bucket", F.floor(F.col("at") / width) if width else F.col("at"))
    line = line.withColumn("_seen", F.when(F.col("burst"), F.col("at")))
    carried = line.filter("burst").groupBy("host", "_bucket").agg(F.max("at").alias("_seen"))
    carried = carried.select("host", (F.col("_bucket") + 1).alias("_bucket"), "_seen", F.col("_seen").alias("at"), F.lit(False).alias("made"))
    w = Window.partitionBy("host", "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.filter("made or burst").unionByName(carried, allowMissingColumns=True).withColumn("_last", F.max("_seen").over(w))
    timed = seen.filter("made").withColumn("after_burst", F.coalesce(F.col("_last") >= F.col("at") - width, F.lit(False))).drop("_bucket", "_seen", "_last")
    return timed.unionByName(rows.filter(F.col("made") & F.col("at").isNull()).withColumn("after_burst", F.lit(False)))


def console_failures(units: DataFrame) -> DataFrame:
    """(at, username, source_ip) of the failed console logins that units show: single ones, and the records that aggregated ones list.

    For units made elsewhere. Those of cloud_units carry what is asked of their failures.
    """
    r = F.col("raw")
    failed = units.filter((F.col("source") == "cloud_audit") & (F.col("action") == "console_login") & (F.lower("status") == "failure"))
    lists = F.coalesce(F.size(r["events"]) > 0, F.lit(False))
    nested = failed.filter(lists).select("timestamp", F.explode(r["events"]).alias("e"))
    nested = nested.select(iso_time(F.col("e.timestamp"), F.col("timestamp")).alias("at"), F.col("e.username").alias("username"), F.col("e.source_ip").alias("source_ip"))
    single = failed.filter(~lists)
    single = single.select(F.col("timestamp").alias("at"), F.coalesce(filled(r["event"]["username"]), F.col("target")).alias("username"), F.coalesce(filled(r["event"]["source_ip"]), F.col("actor")).alias("source_ip"))
    return nested.unionByName(single)


def users_with_failures(records: DataFrame, failures: DataFrame) -> DataFrame:
    """The records whose user has any failed login, whenever."""
    return records.join(failures.select(F.col("username").alias("_user")).filter("_user is not null").distinct(), F.col("event.username") == F.col("_user"), "left_semi")
