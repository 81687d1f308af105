"""Lines to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake import config as C
from sentrylake.functions.text import access_time, filled, syslog_time


def groups(line: Column, pattern: str, many: int) -> Column:
    """The groups of one match of a pattern that takes the whole line, as an array; a line that doesn't fit is an array of one.

    A line is matched once, whatever the number of groups. Groups are parted by line
    ends, which no line holds.
    """
    parts = F.split(F.regexp_replace(line, pattern, "\n".join(f"${i}" for i in range(1, many + 1))), "\n")
    return F.explode(F.array(parts))  # one row; later filters can't bring the match back into themselves


def auth_records(lines: DataFrame, year: int = 2026) -> DataFrame:
    """Syslog auth lines as (kind, ts, ts_error, host, user, ip, cmd, line, line_no); others go.

    A time that can't be read is null with ts_error, so that callers can set such rows
    aside.
    """
    out = lines.select("line", "line_no", groups(F.col("line"), C.SYSLOG_LINE, 12).alias("_p")).filter(F.size("_p") == 12)
    part = lambda i: filled(F.get("_p", F.lit(i - 1)))
    kind = (
        F.when(part(3).isNotNull(), "ssh_fail").when(part(5).isNotNull(), "ssh_invalid").when(part(7).isNotNull(), "ssh_accepted")
        .when(part(10).isNotNull(), "sudo_denied").when(part(11).isNotNull(), "sudo_command")
    )
    out = out.select(
        kind.alias("kind"), syslog_time(part(1), year).alias("ts"), part(2).alias("host"), F.coalesce(part(3), part(5), part(7), part(9)).alias("user"),
        F.coalesce(part(4), part(6), part(8)).alias("ip"), F.when(part(11).isNotNull(), F.get("_p", F.lit(11))).alias("cmd"), "line", "line_no",
    )
    return out.filter(F.col("kind").isNotNull()).withColumn("ts_error", F.col("ts").isNull())


def access_records(lines: DataFrame) -> DataFrame:
    """Combined access-log lines as (ip, ts, ts_error, method, path, status, ua, line, line_no); others go."""
    out = lines.select("line", "line_no", groups(F.col("line"), C.ACCESS_LINE, 7).alias("_p")).filter(F.size("_p") == 7)
    part = lambda i: F.get("_p", F.lit(i - 1))
    out = out.select(part(1).alias("ip"), access_time(part(3)).alias("ts"), part(4).alias("method"), part(5).alias("path"), part(6).alias("status"), part(7).alias("ua"), "line", "line_no")
    return out.withColumn("ts_error", F.col("ts").isNull())
