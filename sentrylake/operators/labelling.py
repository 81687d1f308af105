"""Ground truth from what is known of the scenario behind the logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake import config as C
from sentrylake.config import Scenario, ShapeConfig
from sentrylake.functions.text import any_of, percent_decoded
from sentrylake.operators.bursts import auth_units, cloud_failures, cloud_units, failed_logons, login_bursts, logon_bursts, scan_bursts, web_point, windows_points, windows_units
from sentrylake.operators.numbering import number_units
from sentrylake.operators.rules import port_of


def known(df: DataFrame, key: Column, table: Sequence[tuple], *more: Column) -> DataFrame:
    """Adds technique and rationale from a scenario table (entity..., technique, rationale); null where unknown."""
    names = [f"_e{i}" for i in range(1 + len(more))]
    side = df.sparkSession.createDataFrame(list(table), ", ".join(f"{n} string" for n in names) + ", technique string, rationale string")
    on = key == F.col("_e0")
    for i, c in enumerate(more, 1):
        on = on & (c == F.col(f"_e{i}"))
    return df.join(F.broadcast(side), on, "left").drop(*names)


def marked(df: DataFrame, technique: Column, rationale: Column) -> DataFrame:
    return df.withColumn("technique", technique).withColumn("rationale", rationale).withColumn("label", F.when(F.col("technique").isNotNull(), "incident").otherwise("benign"))


def _benign(df: DataFrame, why: str) -> DataFrame:
    return marked(df, F.lit(None).cast("string"), F.lit(why))


def label_auth(records: DataFrame, shape: ShapeConfig = ShapeConfig(), scenario: Scenario = Scenario()) -> DataFrame:
    """Bursts by known attackers, logins by those who got in; all else benign."""
    units = auth_units(records, shape)
    burst, login = F.col("action") == "ssh_failed_password", F.col("action") == "ssh_accepted_password"
    a = known(units.filter(burst), F.col("actor"), scenario.ssh)
    few = F.concat(F.lit("Only "), F.col("raw.count").cast("string"), F.lit(" failed SSH attempts from an address that isn't a known attacker."))
    a = marked(a, F.col("technique"), F.coalesce("rationale", few))
    b = known(units.filter(login), F.col("actor"), scenario.compromised)
    b = marked(b, F.col("technique"), F.coalesce("rationale", F.lit("Routine login without any guessing before.")))
    return a.unionByName(b).unionByName(_benign(units.filter(~burst & ~login), "A sudo event that alone is no incident."))


def request_class(path: Column, agent: Column) -> tuple[Column, Column]:
    """(technique, rationale) of one request; unlike the shaping classifier, one scanner is missing from its list."""
    decoded, ua = F.lower(percent_decoded(F.coalesce(path, F.lit("")))), F.lower(F.coalesce(agent, F.lit("")))
    attack, scan = ua.contains(C.JNDI) | any_of(decoded, C.SHAPING_PAYLOADS), any_of(ua, C.LABEL_SCANNERS)
    return F.when(attack, "T1190").when(scan, "T1595.002"), F.when(attack, "Attack payload in the request.").when(scan, F.concat(F.lit("Known scanner's user-agent: "), agent))


def label_access(records: DataFrame, shape: ShapeConfig = ShapeConfig(), scenario: Scenario = Scenario()) -> DataFrame:
    """Known scanners as one unit each; else requests by their payload; a browser's long run of 404 as one benign unit; else benign requests."""
    technique, why = request_class(F.col("path"), F.col("ua"))
    r = records.withColumn("_t", technique).withColumn("_why", why)
    first_ua = F.min_by("ua", F.struct("ts", "line_no"))
    profile = r.groupBy("ip").agg(F.max(F.col("_t").isNotNull()).alias("attack"), F.count("*").alias("n"), F.min(F.col("status") == "404").alias("lost"), first_ua.alias("ua0"))
    profile = known(profile, F.col("ip"), scenario.scanners)
    crawl = F.col("lost") & (F.col("n") >= 20) & F.lower("ua0").startswith("mozilla")
    route = F.when(F.col("technique").isNotNull(), "scan").when(F.col("attack"), "requests").when(crawl, "crawl").otherwise("plain")
    r = r.join(profile.select("ip", route.alias("route")), "ip")
    scans = scan_bursts(r.filter("route = 'scan'"), shape)
    scans = known(scans, F.col("actor"), scenario.scanners)
    scans = marked(scans, F.col("technique"), F.col("rationale"))
    crawls = _benign(scan_bursts(r.filter("route = 'crawl'"), shape), "Many 404 from a browser on sequential pages: a broken-link crawl.")
    crawls = crawls.withColumn("target", F.concat(F.col("raw.count").cast("string"), F.lit(" sequential paths")))
    single = r.filter("route in ('requests', 'plain')").select(*web_point(), "_t", "_why")
    single = marked(single, F.col("_t"), F.coalesce("_why", F.lit("Ordinary web request."))).drop("_t", "_why")
    return scans.unionByName(crawls).unionByName(single)


def label_login_posts(records: DataFrame, shape: ShapeConfig = ShapeConfig(), scenario: Scenario = Scenario()) -> DataFrame:
    """Known guessers' requests as one unit each, others benign."""
    r = known(records, F.col("ip"), scenario.web_logins)
    bursts = known(login_bursts(r.filter("technique is not null").drop("technique", "rationale"), shape), F.col("actor"), scenario.web_logins)
    bursts = marked(bursts.withColumn("status", F.lit("401")), F.col("technique"), F.col("rationale"))
    return bursts.unionByName(_benign(r.filter("technique is null").select(*web_point()), "Ordinary web request."))


def label_windows(records: DataFrame, shape: ShapeConfig = ShapeConfig(), scenario: Scenario = Scenario()) -> DataFrame:
    """Known groups of failed logons, encoded or downloading command lines, new accounts; all else benign."""
    failed = known(failed_logons(records), F.col("ghost"), scenario.logons, F.col("gip"))
    bursts = known(logon_bursts(failed.filter("technique is not null").drop("technique", "rationale"), shape), F.col("raw.host"), scenario.logons, F.col("actor"))
    bursts = marked(bursts, F.col("technique"), F.col("rationale"))
    single = windows_points(failed.filter("technique is null"), F.lit("logon_failure"), F.col("event.host"), F.lit("failure"))
    rest = windows_units(records.filter("event.event_code <> '4625'"), shape).filter("action <> 'logoff'")
    command = F.lower(F.coalesce("raw.event.command_line", F.lit("")))
    technique = (
        F.when((F.col("action") == "process_creation") & any_of(command, ("-enc", "-encodedcommand")), "T1059.001")
        .when((F.col("action") == "process_creation") & command.contains("certutil") & any_of(command, ("urlcache", "http")), "T1105")
        .when(F.col("action") == "user_account_created", "T1136.001")
    )
    why = F.when(technique == "T1059.001", "Encoded PowerShell command line.").when(technique == "T1105", "certutil fetches a remote file.").when(technique == "T1136.001", "Account made after failed logons.").otherwise("Routine Windows event.")
    return bursts.unionByName(_benign(single, "A mistyped password.")).unionByName(marked(rest, technique, why))


def label_cloud(records: DataFrame, shape: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Groups opened to the world on sensitive ports, IAM changes by users with failed logins; all else benign; unknown actions go."""
    units = cloud_units(records, shape).filter(F.col("action").isin("console_login", "api_key_created", "security_group_rule_added", "iam_policy_changed"))
    failed = cloud_failures(records).select(F.col("username").alias("_u")).filter("_u is not null").distinct()
    e = F.col("raw.event")
    units = units.join(failed, e["username"] == F.col("_u"), "left")
    opened = (F.col("action") == "security_group_rule_added") & (e["cidr"] == C.OPEN_CIDR) & port_of(e["port"]).isin(*C.SENSITIVE_PORTS)
    changed = (F.col("action") == "iam_policy_changed") & F.col("_u").isNotNull()
    technique = F.when(opened, "T1562.007").when(changed, "T1098")
    why = F.when(technique == "T1562.007", "Sensitive port opened to the whole internet.").when(technique == "T1098", "IAM change by a user with failed logins.").otherwise("Routine cloud event.")
    return marked(units, technique, why).drop("_u")


def assembled(*parts: DataFrame) -> DataFrame:
    """Numbered labelled rows (unit_id, event, label, technique, rationale) of all builders together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    mark = F.struct("label", "technique", "rationale")
    every = every.withColumn("raw_", F.col("raw")).withColumn("_mark", mark)
    packed = every.withColumn("raw", F.struct("raw_", "_mark"))
    numbered = number_units(packed)
    unit = F.struct("id", "source", "timestamp", "actor", "action", "target", "status", F.col("raw.raw_").alias("raw"))
    return numbered.select(F.col("id").alias("unit_id"), unit.alias("event"), "raw._mark.label", "raw._mark.technique", "raw._mark.rationale")
