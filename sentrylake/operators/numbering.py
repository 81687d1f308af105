"""Numbers of rows in an order, without a task that holds a whole group; unit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.config import ID_PREFIX
from sentrylake.sources.scratch import scratch_path

ORDER = ("timestamp", "action", "_target", "line_no")


def numbered(df: DataFrame, group: str, order: tuple[str, ...], name: str, partitions: int, table: str, few: bool = False) -> DataFrame:
    """Adds `name`: the row's number, from 1, in its group (never null) by `order`.

    Rows are dealt in ranges of (group, order), sorted and written to `table` (a path all
    executors share) with a number that rises along each range; what comes before a
    range in a group is a sum over a row for each range and group. few: groups are so
    few (a fixed list of names) that these rows, one or two a range, pass through the
    driver and go to every task, so that the table can be read without a shuffle.
    """
    dealt = df.repartitionByRange(partitions, group, *order).sortWithinPartitions(group, *order)
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(table)
    kept = df.sparkSession.read.parquet(table).withColumn("_range", F.shiftright("_id", 33))
    parts = kept.groupBy(group, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).drop("_first", "_size")
    if few:
        parts = F.broadcast(df.sparkSession.createDataFrame(parts.collect(), parts.schema))
    return kept.join(parts, [group, "_range"]).withColumn(name, F.col("_id") + F.col("_before")).drop("_id", "_range", "_before")


def _id(n: Column) -> Column:
    prefix = None
    for source, p in ID_PREFIX.items():
        prefix = F.when(F.col("source") == source, p) if prefix is None else prefix.when(F.col("source") == source, p)
    return F.concat(prefix, F.lit("-"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")))


def number_units(units: DataFrame) -> DataFrame:
    """Ids of all units, by ranges in the folder that executors share; as many ranges as the session has shuffle partitions."""
    spark = units.sparkSession
    return number_units_at_scale(units, int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, "units"))


def number_units_in_window(units: DataFrame) -> DataFrame:
    """The same ids by a window over each source; for tables whose sources fit a task each."""
    w = Window.partitionBy("source").orderBy(*ORDER)
    return _final(units.withColumn("_target", F.coalesce("target", F.lit("None"))).withColumn("_n", F.row_number().over(w)))


def number_units_at_scale(units: DataFrame, partitions: int, table: str) -> DataFrame:
    """The same ids by ranges written to `table`. There are four sources, so what comes before a range is a few rows."""
    return _final(numbered(units.withColumn("_target", F.coalesce("target", F.lit("None"))), "source", ORDER, "_n", partitions, table, few=True))


def _final(df: DataFrame) -> DataFrame:
    return df.select(_id(F.col("_n")).alias("id"), "source", "timestamp", "actor", "action", "target", "status", "raw")
