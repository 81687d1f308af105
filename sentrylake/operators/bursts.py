"""Records to analysis units: one login, one request, or one whole burst.

Counts of a burst are plain aggregates, added up before the shuffle. The few lines a
burst keeps come from a rank that is cut to those few, which each task does for its
own rows first, so a hot address sends a few lines from each task and is never sorted
whole. Records are written once, as several steps read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.config import ShapeConfig
from sentrylake.functions.text import filled, iso_time, login_like, status_sequence, web_payload
from sentrylake.operators.numbering import numbered
from sentrylake.schemas import raw, unit
from sentrylake.sources.scratch import scratch_path, stored


def leading(records: DataFrame, keys: list[str], most: int, *columns: str, order: tuple = ("ts", "line_no")) -> DataFrame:
    """Of each burst (keys), the columns as lists over its first `most` records, in order; ties stay in file order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = records.select(*keys, *dict.fromkeys([*order, *columns])).withColumn("rn", rank).filter(F.col("rn") <= most)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(c).alias("v")))), lambda x: x["v"]).alias(f"first_{c}")
    return first.groupBy(*keys).agg(*[listed(c) for c in columns])


def samples(lines: Column, count: Column, most: int) -> Column:
    """`most` lines, or one fewer and a note of how many more there are."""
    note = F.concat(F.lit("... (+"), (count - (most - 1)).cast("string"), F.lit(" more lines)"))
    return F.when(count <= most, lines).otherwise(F.concat(F.slice(lines, 1, most - 1), F.array(note)))


def auth_units(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """One unit for all failures of an address, even a single one; other records one each."""
    source = F.lit("linux_auth")
    records = stored(records, "auth")
    fails = records.filter(F.col("kind").isin("ssh_fail", "ssh_invalid"))
    burst = fails.groupBy("ip").agg(
        F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.sort_array(F.collect_set("user")).alias("users"), F.min("line_no").alias("line_no"),
    )
    burst = burst.join(leading(fails, ["ip"], shape.samples, "line"), "ip")
    target = F.concat(F.array_join(F.slice("users", 1, 5), ", "), F.when(F.size("users") > 5, " ...").otherwise(""))
    bursts = burst.select(
        *unit(
            source=source, timestamp=F.col("t0"), actor=F.col("ip"), action=F.lit("ssh_failed_password"), target=target, status=F.lit("failure"), line_no=F.col("line_no"),
            raw=raw(count=F.col("n"), window_start=F.col("t0"), window_end=F.col("t1"), sample_lines=samples(F.col("first_line"), F.col("n"), shape.samples), distinct_users=F.col("users"), source=source),
        )
    )
    kind = F.col("kind")
    points = records.filter(kind.isin("ssh_accepted", "sudo_denied", "sudo_command")).select(
        *unit(
            source=source, timestamp=F.col("ts"), actor=F.when(kind == "ssh_accepted", F.col("ip")).otherwise(F.col("user")),
            action=F.when(kind == "ssh_accepted", "ssh_accepted_password").when(kind == "sudo_denied", "sudo_not_in_sudoers").otherwise("sudo_command"),
            target=F.when(kind == "ssh_accepted", F.col("user")).when(kind == "sudo_denied", "root").otherwise(F.col("cmd")),
            status=F.when(kind == "sudo_denied", "failure").otherwise("success"), line_no=F.col("line_no"),
            raw=raw(line=F.col("line"), command=F.col("cmd"), source=source),
        )
    )
    return bursts.unionByName(points)


def web_profile(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """What decides an address's route: payload first, then a login burst, then a run of nothing but 404."""
    post = (F.upper("method") == "POST") & login_like(F.col("path"))
    p = records.groupBy("ip").agg(
        F.max(web_payload(F.col("path"), F.col("ua")).isNotNull()).alias("payload"), F.count_if(post).alias("posts"), F.count("*").alias("n"), F.min(F.col("status") == "404").alias("lost")
    )
    route = F.when(F.col("payload"), "points").when(F.col("posts") >= shape.login_posts, "login").when(F.col("lost") & (F.col("n") >= shape.scan), "scan").otherwise("points")
    return p.withColumn("route", route)


def web_point(source: Column = None) -> list[Column]:
    source = F.lit("nginx_access") if source is None else source
    return unit(
        source=source, timestamp=F.col("ts"), actor=F.col("ip"), action=F.concat(F.lit("http_"), F.lower("method")), target=F.col("path"), status=F.col("status"),
        line_no=F.col("line_no"), raw=raw(line=F.col("line"), path=F.col("path"), user_agent=F.col("ua"), source=source),
    )


def status_runs(records: DataFrame, minutes: int = 10) -> DataFrame:
    """(ip, status_runs): each address's statuses in order of time, as runs of equal ones.

    Runs are found in stretches of `minutes` first, so that an address's records spread
    over tasks; an address's runs then meet, and those that go on over a border are joined.
    """
    starts = lambda w: F.coalesce((~F.lag("status").over(w).eqNullSafe(F.col("status"))).cast("int"), F.lit(1))
    w = Window.partitionBy("ip", "_stretch").orderBy("ts", "line_no")
    r = records.select("ip", "ts", "line_no", "status", F.floor(F.unix_timestamp("ts") / (60 * minutes)).alias("_stretch")).withColumn("_run", F.sum(starts(w)).over(w))
    r = r.groupBy("ip", "_stretch", "_run").agg(F.min("status").alias("status"), F.count("*").alias("n"))
    w = Window.partitionBy("ip").orderBy("_stretch", "_run")
    r = r.withColumn("_all", F.sum(starts(w)).over(w)).groupBy("ip", "_all").agg(F.min("status").alias("status"), F.sum("n").alias("n"))
    return r.groupBy("ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("_all", "status", "n"))), lambda x: F.struct(x["status"].alias("status"), x["n"].alias("n"))).alias("status_runs"))


def login_bursts(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """One unit for each address of records that are all login posts, with its statuses in order as runs."""
    at = F.struct("ts", "line_no")
    g = records.groupBy("ip").agg(
        F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("path", at).alias("path"),
        F.min_by("status", at).alias("first"), F.max_by("status", at).alias("last"), F.min("line_no").alias("line_no"),
    )
    g = g.join(leading(records, ["ip"], shape.samples, "line"), "ip")
    g = g.join(status_runs(records, shape.run_minutes), "ip")
    spread = status_sequence(F.struct(F.lit(None).cast("array<string>").alias("status_sequence"), "status_runs")) if shape.full_sequences else F.lit(None)
    source = F.lit("nginx_access")
    return g.select(
        *unit(
            source=source, timestamp=F.col("t0"), actor=F.col("ip"), action=F.lit("http_post"), target=F.col("path"), status=F.col("first"), line_no=F.col("line_no"),
            raw=raw(count=F.col("n"), window_start=F.col("t0"), window_end=F.col("t1"), sample_lines=samples(F.col("first_line"), F.col("n"), shape.samples), status_sequence=spread, status_runs=F.col("status_runs"), final_status=F.col("last"), source=source),
        )
    )


def scan_bursts(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """One unit for each address, with its agents, its first paths and how many it has."""
    g = records.groupBy("ip").agg(
        F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count_distinct("path").alias("k"),
        F.max_by("status", F.struct("ts", "line_no")).alias("last"), F.min("line_no").alias("line_no"),
    )
    g = g.join(records.groupBy("ip").agg(F.sort_array(F.collect_set("ua")).alias("uas")), "ip")
    g = g.join(leading(records, ["ip"], shape.samples, "line"), "ip").join(leading(records, ["ip"], shape.sample_paths, "path"), "ip")
    source = F.lit("nginx_access")
    return g.select(
        *unit(
            source=source, timestamp=F.col("t0"), actor=F.col("ip"), action=F.lit("http_get"), line_no=F.col("line_no"), status=F.col("last"),
            target=F.when(F.col("k") == 1, F.get("first_path", F.lit(0))).otherwise(F.concat(F.col("k").cast("string"), F.lit(" paths"))),
            raw=raw(count=F.col("n"), window_start=F.col("t0"), window_end=F.col("t1"), sample_lines=samples(F.col("first_line"), F.col("n"), shape.samples), user_agents=F.col("uas"), sample_paths=F.col("first_path"), source=source),
        )
    )


def access_units(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    records = stored(records, "access")
    routed = records.join(web_profile(records, shape).select("ip", "route"), "ip")
    post = (F.upper("method") == "POST") & login_like(F.col("path"))
    points = routed.filter((F.col("route") == "points") | ((F.col("route") == "login") & ~post))
    return points.select(*web_point()).unionByName(login_bursts(routed.filter((F.col("route") == "login") & post), shape)).unionByName(scan_bursts(routed.filter("route = 'scan'"), shape))


def _win_actor() -> Column:
    return F.coalesce(filled(F.col("event.source_ip")), F.col("event.username"))


def windows_points(records: DataFrame, action: Column, target: Column, status: Column) -> DataFrame:
    source = F.lit("windows_security")
    return records.select(
        *unit(source=source, timestamp=iso_time(F.col("event.timestamp")), actor=_win_actor(), action=action, target=target, status=status, line_no=F.col("line_no"), raw=raw(event=F.col("event"), source=source))
    )


def failed_logons(records: DataFrame) -> DataFrame:
    """4625 records with their group: host (``?`` if missing) and address as text (``None`` if missing)."""
    f = records.filter(F.col("event.event_code") == "4625")
    return f.withColumn("ghost", F.coalesce("event.host", F.lit("?"))).withColumn("gip", F.coalesce("event.source_ip", F.lit("None")))


def logon_bursts(grouped: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """One unit for each (host, address), in file order."""
    source = F.lit("windows_security")
    g = grouped.groupBy("ghost", "gip").agg(
        F.count("*").alias("n"), F.min_by("event.timestamp", "line_no").alias("t"), F.min_by("event.source_ip", "line_no").alias("ip"),
        F.sort_array(F.collect_set(filled(F.col("event.username")))).alias("users"), F.min("line_no").alias("line_no"),
    )
    g = g.join(leading(grouped, ["ghost", "gip"], shape.samples, "line", order=("line_no",)), ["ghost", "gip"])
    return g.select(
        *unit(
            source=source, timestamp=iso_time(F.col("t")), actor=F.col("ip"), action=F.lit("logon_failure"), target=F.array_join("users", ", "), status=F.lit("failure"), line_no=F.col("line_no"),
            raw=raw(count=F.col("n"), event_code=F.lit("4625"), host=F.col("ghost"), distinct_users=F.col("users"), sample_lines=F.col("first_line"), source=source),
        )
    )


def windows_units(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """records: line, line_no, event. Failed logons of one host and address make one unit from `shape.windows` on."""
    records = stored(records, "windows")
    failed = failed_logons(records)
    sizes = failed.groupBy("ghost", "gip").agg(F.count("*").alias("size"))
    failed = failed.join(sizes, ["ghost", "gip"])
    few = windows_points(failed.filter(F.col("size") < shape.windows), F.lit("logon_failure"), F.col("event.host"), F.lit("failure"))
    code, host = F.col("event.event_code"), F.col("event.host")
    action = F.when(code == "4624", "logon_success").when(code == "4634", "logoff").when(code == "4672", "special_privileges_assigned").when(code == "4688", "process_creation").when(code == "4720", "user_account_created")
    target = F.when(code == "4688", F.coalesce(filled(F.col("event.process_name")), host)).when(code == "4720", F.coalesce(filled(F.col("event.new_account")), host)).otherwise(host)
    rest = windows_points(records.filter(code.isin("4624", "4634", "4672", "4688", "4720")), action, target, F.lit("success"))
    return logon_bursts(failed.filter(F.col("size") >= shape.windows), shape).unionByName(few).unionByName(rest)


def console_failure(record: Column) -> Column:
    return F.coalesce((record["action"] == "console_login") & (record["status"] == "failure"), F.lit(False))


def cloud_failures(records: DataFrame) -> DataFrame:
    """(line_no, at, username, source_ip, event) of every failed console login: the records behind the aggregated unit."""
    e = F.col("event")
    return records.filter(console_failure(e)).select("line_no", iso_time(e["timestamp"]).alias("at"), e["username"].alias("username"), e["source_ip"].alias("source_ip"), "event")


def cloud_failure_unit(failures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All failed console logins as one unit (or one for each of `keys`, event fields), with its first record; cloud_members lists all.

    failures: from cloud_failures.
    """
    source = F.lit("cloud_audit")
    first = F.min_by("event", "line_no")
    by = [F.col("event")[k].alias(f"k_{k}") for k in keys]
    g = failures.groupBy(*by).agg(F.count("*").alias("n"), first.alias("e"), F.min("line_no").alias("line_no")).filter("n > 0")
    e = F.col("e")
    return g.select(
        *unit(
            source=source, timestamp=iso_time(e["timestamp"]), actor=e["source_ip"], action=F.lit("console_login"), target=e["username"], status=F.lit("failure"), line_no=F.col("line_no"),
            raw=raw(count=F.col("n"), events=F.array(e), source=source),
        )
    )


def cloud_members(units: DataFrame, failures: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, place, line_no, at, username, source_ip, event): every record of each aggregated unit of numbered units, places from 1 in file order.

    failures and keys: those the units were made from. Failures are written once, as
    dealing them in ranges reads them twice. Without keys the one unit goes to every
    task: a join on equal constants would become a Cartesian product, which makes the
    failures anew for each pair of partitions.
    """
    spark = units.sparkSession
    made = units.filter((F.col("source") == "cloud_audit") & (F.col("action") == "console_login") & (F.col("raw.count").isNotNull()))
    failures = stored(failures, "failures")
    if keys:
        own = lambda e: F.to_json(F.array(*[e[k] for k in keys]))
        made = made.select(F.col("id").alias("unit_id"), own(F.get("raw.events", F.lit(0))).alias("_key"))
        owned = failures.withColumn("_key", own(F.col("event"))).join(made, "_key").drop("_key")
    else:
        owned = failures.crossJoin(F.broadcast(made.select(F.col("id").alias("unit_id"))))
    return numbered(owned, "unit_id", ("line_no",), "place", int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, "members"))


def with_first_failure(changes: DataFrame, failures: DataFrame, user: Column, ip: Column) -> DataFrame:
    """Adds first_failure: the earliest failed login (at, username, source_ip) of the change's user or from its address; null if none.

    "Or" is split into two earliest-failure tables, so both joins are on equal keys and
    keep one row for each change. Empty and missing users and addresses match nothing.
    """
    first = lambda key: failures.filter(filled(F.col(key)).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min("at").alias(f"_by_{key}"))
    df = changes.withColumn("_u", user).withColumn("_ip", ip)
    df = df.join(first("username"), F.col("_u") == F.col("_username"), "left").join(first("source_ip"), F.col("_ip") == F.col("_source_ip"), "left")
    return df.withColumn("first_failure", F.least("_by_username", "_by_source_ip")).drop("_u", "_ip", "_username", "_source_ip", "_by_username", "_by_source_ip")


def cloud_units(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """One unit for each record but the failed console logins, which are one; an IAM change carries when its user or address first failed to log in."""
    return stored_cloud_units(stored(records.select("line_no", "event"), "cloud"))


def stored_cloud_units(records: DataFrame) -> DataFrame:
    """cloud_units of records (line_no, event) that are written already, for callers that read them again themselves."""
    failures = cloud_failures(records)
    e = F.col("event")
    target = (
        F.when(e["action"] == "security_group_rule_added", F.concat(F.lit("port "), F.coalesce(e["port"], F.lit("None")), F.lit(" <- "), F.coalesce(e["cidr"], F.lit("None"))))
        .when(e["action"] == "iam_policy_changed", F.coalesce(filled(e["target_user"]), e["policy_name"]))
        .otherwise(e["username"])
    )
    source = F.lit("cloud_audit")
    points = lambda df, **more: df.select(
        *unit(
            source=source, timestamp=iso_time(e["timestamp"]), actor=F.coalesce(filled(e["source_ip"]), e["username"]), action=F.coalesce(filled(e["action"]), F.lit("unknown")),
            target=target, status=F.coalesce(e["status"], F.lit("unknown")), line_no=F.col("line_no"), raw=raw(event=e, source=source, **more),
        )
    )
    change = F.coalesce(e["action"] == "iam_policy_changed", F.lit(False))
    changes = with_first_failure(records.filter(change), failures, e["username"], e["source_ip"])
    changes = points(changes, facts=F.struct("first_failure"))
    return points(records.filter(~console_failure(e) & ~change)).unionByName(changes).unionByName(cloud_failure_unit(failures))
