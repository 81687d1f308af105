"""Seven rules over units, the first that fits deciding.

Each source meets only its own rules. What several rules ask of a unit is worked out
once, then the number of the rule that decides; technique, confidence and reason
follow from that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake import config as C
from sentrylake.config import RuleConfig
from sentrylake.functions.text import confidence_by_count, filled, first_of, percent_decoded
from sentrylake.operators.bursts import with_first_failure
from sentrylake.operators.correlate import after_bursts, console_failures, windows_field


def _count() -> Column:
    return F.coalesce(F.col("raw.count"), F.lit(1))


def candidate_paths() -> Column:
    """The decoded paths of a web unit: its own, its samples, and its target unless that only says how many."""
    target = F.when(~F.col("target").endswith("paths"), filled(F.col("target")))
    some = F.flatten(F.array(F.array(filled(F.col("raw.path"))), F.coalesce(F.col("raw.sample_paths"), F.array().cast("array<string>")), F.array(target)))
    return F.transform(F.array_compact(some), percent_decoded)


def candidate_agents() -> Column:
    some = F.concat(F.array(filled(F.col("raw.user_agent"))), F.coalesce(F.col("raw.user_agents"), F.array().cast("array<string>")))
    return F.transform(F.array_compact(some), F.lower)


def statuses() -> Column:
    """Every status that a web unit mentions, in its sample lines too."""
    of_line = F.transform(F.coalesce(F.col("raw.sample_lines"), F.array().cast("array<string>")), lambda x: filled(F.regexp_extract(x, r'"\s+(\d{3})\s+\d+', 1)))
    own = F.array(F.col("status"), F.col("raw.final_status"))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return F.array_compact(F.concat(own, some(F.col("raw.status_sequence")), some(F.col("raw.status_runs.status")), of_line))


def _first(values: Column, needles) -> Column:
    """The first needle in the first value that has one."""
    hits = F.array_compact(F.transform(values, lambda v: first_of(v, needles)))
    return F.get(hits, F.lit(0))


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])


def port_of(c: Column) -> Column:
    """A port as an integer; numbers with a fraction are cut, text that is no number is -1."""
    return F.coalesce(c.try_cast("int"), F.floor(F.when(c.rlike(r"^\d+\.\d+$"), c.try_cast("double"))).cast("int"), F.lit(-1))


def _decided(df: DataFrame, *cases: tuple[Column, str, Column | float, Column]) -> DataFrame:
    """(unit_id, is_incident, technique, confidence, reason, _keep) by the first case (condition, technique, confidence, reason) that fits."""
    rule = technique = confidence = reason = None
    for i, (fits, what, sure, why) in enumerate(cases):
        here = F.col("_rule") == i
        sure = sure if isinstance(sure, Column) else F.lit(sure)
        rule = F.when(fits, i) if rule is None else rule.when(fits, i)
        technique = F.when(here, what) if technique is None else technique.when(here, what)
        confidence = F.when(here, sure) if confidence is None else confidence.when(here, sure)
        reason = F.when(here, why) if reason is None else reason.when(here, why)
    return df.withColumn("_rule", rule).select(
        F.col("id").alias("unit_id"), F.col("_rule").isNotNull().alias("is_incident"), technique.cast("string").alias("technique"),
        F.coalesce(confidence.cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(reason, F.lit("No rule matched.")).alias("reason"), "_keep",
    )


# Reason texts are fixed values: they say what they must for a verdict's reader.
def auth_verdicts(units: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    df = units.select("id", "_keep", "actor", "action", "target", _count().alias("n"))
    n, fits = F.col("n"), (F.col("action") == "ssh_failed_password") & (F.col("n") > cfg.ssh)
    why = _text("SSH Brute Force: ", n, " failed SSH password attempts from ", F.col("actor"), f" (> {cfg.ssh} in window); target users ", F.col("target"), ".")
    return _decided(df, (fits, "T1110.001", confidence_by_count(n, 0.75, 0.9, 0.99), why))


def web_verdicts(units: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """An exploit's payload, then guessed logins, then a scanner, then a run of 404, then a sensitive path that was found."""
    df = units.select("id", "_keep", "actor", "target", "status", _count().alias("n"), candidate_paths().alias("_raw"), candidate_agents().alias("_agents"), statuses().alias("_statuses"))
    df = df.withColumn("_paths", F.transform("_raw", F.lower))
    detail = F.coalesce(
        F.concat(F.lit("payload signature '"), _first(F.col("_paths"), C.EXPLOIT_PAYLOADS), F.lit("' in path")),
        F.when(F.exists(F.concat("_paths", "_agents"), lambda x: x.contains(C.JNDI)), "Log4Shell/JNDI marker"),
        F.when(F.exists("_raw", lambda x: x.rlike(C.COMMAND_INJECTION)), "OS command-injection pattern in path"),
    )
    said = lambda words: F.arrays_overlap("_statuses", F.array(*map(F.lit, words)))
    df = df.select(
        "id", "_keep", "actor", "target", "status", "n", detail.alias("detail"), F.exists("_paths", lambda p: first_of(p, C.LOGIN_PATHS).isNotNull()).alias("login"),
        said(C.AUTH_FAIL_STATUSES).alias("refused"), said(C.FOUND_STATUSES).alias("found"), _first(F.col("_agents"), C.SCANNERS).alias("scanner"), _first(F.col("_paths"), C.SENSITIVE_PATHS).alias("hit"),
    )
    n, who, what = F.col("n"), F.col("actor"), F.col("target")
    return _decided(
        df,
        (F.col("detail").isNotNull(), "T1190", 0.95, _text("Web Exploit Attempt: ", F.col("detail"), " from ", who, " against ", what, ".")),
        (F.col("login") & F.col("refused") & (n > cfg.web_login), "T1110", confidence_by_count(n, 0.8, 0.9, 0.97), _text("Web Login Brute Force: ", n, " failed web logins from ", who, " to ", what, f" (> {cfg.web_login} in window).")),
        (F.col("scanner").isNotNull(), "T1595.002", 0.9, _text("Web Scanning: known scanner User-Agent '", F.col("scanner"), "' from ", who, ".")),
        ((F.col("status") == "404") & (n > cfg.not_found), "T1595.002", confidence_by_count(n, 0.7, 0.85, 0.95), _text("Web Scanning: ", n, " HTTP 404 responses from ", who, f" (> {cfg.not_found} in window), consistent with directory brute force.")),
        (F.col("hit").isNotNull() & F.col("found"), "T1083", 0.75, _text("Sensitive Path Access: request to '", F.col("hit"), "' returned a found status from ", who, ", consistent with file/directory discovery.")),
    )


def windows_verdicts(units: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    code = windows_field(F.col("raw"), "event_code")
    burst, made = F.coalesce((code == "4625") & (_count() > cfg.windows), F.lit(False)), F.coalesce(code == "4720", F.lit(False))
    name = F.coalesce(filled(F.col("raw.event.new_account")), F.col("target"))
    line = units.select("id", "_keep", name.alias("name"), windows_field(F.col("raw"), "host").alias("host"), F.unix_micros("timestamp").alias("at"), burst.alias("burst"), made.alias("made"))
    why = _text("Account Created After Failed Logons: new account '", F.col("name"), "' on ", F.col("host"), f" within {cfg.account_minutes}m of a failed-logon burst.")
    followed = _decided(after_bursts(line, cfg.account_minutes), (F.col("after_burst"), "T1136.001", 0.9, why))
    return followed.unionByName(_benign(line.filter(~F.col("made"))))


def cloud_verdicts(units: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """A sensitive port opened to all addresses, then an IAM change after a failed login.

    Changes carry their first failed login where they were shaped; for those that don't
    (units made elsewhere) it is looked up among the failed logins that the units show.
    """
    e = F.col("raw.event")
    df = units.select("id", "_keep", "actor", "action", "timestamp", filled(e["username"]).alias("user"), e["source_ip"].alias("ip"), e["cidr"].alias("cidr"), port_of(e["port"]).alias("port"), F.col("raw.facts").alias("facts"))
    change = F.coalesce(F.col("action") == "iam_policy_changed", F.lit(False))
    shaped = df.filter(~change | F.col("facts").isNotNull()).withColumn("first_failure", F.col("facts.first_failure"))
    other = with_first_failure(df.filter(change & F.col("facts").isNull()), console_failures(units), F.col("user"), F.col("ip"))
    data = F.col("port").isin(*C.DATABASE_PORTS)
    opened = F.col("action").contains("security_group_rule") & (F.col("cidr") == C.OPEN_CIDR) & F.col("port").isin(*C.SENSITIVE_PORTS)
    by_whom = _text("Security Group Opened to Internet: ", F.when(data, "database").otherwise("remote-access"), " port ", F.col("port"), f" exposed to {C.OPEN_CIDR} by ", F.coalesce("user", "actor"), ".")
    changed = _text("IAM Change After Login Failure: ", F.col("action"), " by ", F.coalesce("user", "ip"), " which had recent console-login failures.")
    failed = F.coalesce(change & (F.col("first_failure") <= F.col("timestamp")), F.lit(False))
    return _decided(shaped.unionByName(other), (opened, "T1562.007", F.when(data, 0.95).otherwise(0.9), by_whom), (failed, "T1098", 0.8, changed))


def _benign(units: DataFrame) -> DataFrame:
    return _decided(units.select("id", "_keep"), (F.lit(False), "", 0.5, F.lit("")))


JUDGES = {"linux_auth": auth_verdicts, "nginx_access": web_verdicts, "windows_security": windows_verdicts, "cloud_audit": cloud_verdicts}


def rule_verdicts(units: DataFrame, cfg: RuleConfig = RuleConfig(), sources: tuple[str, ...] = C.SOURCES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, is_incident, technique, confidence, reason) for every unit, and columns of it to keep; labels are never read.

    sources: those that the units are known to have; the rules of others aren't planned.
    """
    units = units.withColumn("_keep", F.struct(*keep) if keep else F.lit(None))
    known = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    out = _benign(units.filter(~known))
    for source in sources:
        out = out.unionByName(JUDGES[source](units.filter(F.col("source") == source), cfg))
    return out.select("unit_id", "is_incident", "technique", "confidence", "reason", *[F.col("_keep")[c].alias(c) for c in keep])


def label_blind(labelled: DataFrame) -> DataFrame:
    """Only the units of labelled rows."""
    return labelled.select("event.*")
