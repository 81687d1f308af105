"""Parsing, shaping, rules and correlations on hand-written lines."""

import json

import pytest
from pyspark.sql import functions as F

from sentrylake.config import RuleConfig, ShapeConfig
from sentrylake.functions import text as T
from sentrylake.operators import bursts, correlate, disagree, heuristic, hybrid, labelling, numbering, parse, responses, rules, scoring
from sentrylake.plans.detection import units_of
from sentrylake.schemas import LABELED, UNIT_FIELDS, raw
from sentrylake.sources import readers, writers


def lines(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no long, line string")


def ssh(minute, ip, user="root", second=0):
    return f"Jan 10 09:{minute:02d}:{second:02d} web-01 sshd[1]: Failed password for {user} from {ip} port 1 ssh2"


def web(ip, path, status, method="GET", ua="Mozilla/5.0", minute=0, second=0):
    return f'{ip} - - [10/Jan/2026:08:{minute:02d}:{second:02d} +0000] "{method} {path} HTTP/1.1" {status} 12 "-" "{ua}"'


def test_auth_records(spark):
    rows = [
        "Jan  1 09:00:01 web-01 sshd[1]: Accepted password for deploy from 203.0.113.5 port 52100 ssh2",
        "Jan 10 09:05:01 web-01 sudo: deploy : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/usr/bin/id -a",
        ssh(1, "192.0.2.1"),
        "Jan 10 09:10:54 web-01 sshd[1]: Failed password for invalid user x from 192.0.2.1 port 1 ssh2",
        "Jan 10 09:10:54 web-01 sshd[1]: Invalid user y from 192.0.2.2 port 1",
        "Jan 10 09:14:30 web-01 sudo: bad : command not allowed ; TTY=pts/1 ; NOT in sudoers",
        "Jan 99 09:14:30 web-01 sshd[1]: Invalid user z from 192.0.2.2 port 1",
        "nothing of note",
    ]
    got = {r.line_no: r for r in parse.auth_records(lines(spark, rows)).withColumn("sec", F.unix_timestamp("ts")).collect()}
    assert sorted(got) == list(range(7))
    assert [got[i].kind for i in range(7)] == ["ssh_accepted", "sudo_command", "ssh_fail", "ssh_fail", "ssh_invalid", "sudo_denied", "ssh_invalid"]
    assert got[0].sec == 1767258001 and got[1].cmd == "/usr/bin/id -a" and got[3].user == "x" and got[1].ip is None
    assert got[6].ts_error and got[6].ts is None and not got[0].ts_error


def test_lone_failure_is_a_burst_of_one_and_samples_are_cut(spark):
    rows = [ssh(5, "192.0.2.9")] + [ssh(i, "192.0.2.1", f"u{i % 7}") for i in range(13)]
    units = {u.actor: u for u in units_of(auth=lines(spark, rows)).collect()}
    assert units["192.0.2.9"].raw["count"] == 1
    u = units["192.0.2.1"]
    assert u.raw["count"] == 13 and u.raw["sample_lines"][3] == "... (+10 more lines)" and len(u.raw["sample_lines"]) == 4
    assert u.target == "u0, u1, u2, u3, u4 ..." and len(u.raw["distinct_users"]) == 7


def test_web_routes(spark):
    rows = [web("10.0.0.1", "/login", 401, "POST", second=i) for i in range(5)] + [web("10.0.0.1", "/about", 200)]
    rows += [web("10.0.0.2", "/login", 401, "POST", second=i) for i in range(4)]
    rows += [web("10.0.0.3", f"/p{i}", 404, second=i) for i in range(10)] + [web("10.0.0.4", f"/p{i}", 404) for i in range(9)]
    rows += [web("10.0.0.5", f"/p{i}", 404) for i in range(11)] + [web("10.0.0.5", "/", 200)]
    rows += [web("10.0.0.6", f"/p{i}", 404) for i in range(12)] + [web("10.0.0.6", "/?q=1%20UNION%20SELECT", 404)]
    n = {r.actor: r["count"] for r in units_of(access=lines(spark, rows)).groupBy("actor").count().collect()}
    assert n == {"10.0.0.1": 2, "10.0.0.2": 4, "10.0.0.3": 1, "10.0.0.4": 9, "10.0.0.5": 12, "10.0.0.6": 13}


def test_rows_out_of_order_are_ranked_by_time(spark):
    rows = [web("10.0.0.1", f"/login{i}", 400 + i, "POST", second=9 - i) for i in range(6)]
    u = units_of(access=lines(spark, rows)).first()
    assert [r.status for r in u.raw["status_runs"]] == ["405", "404", "403", "402", "401", "400"] and u.raw["final_status"] == "400" and u.target == "/login5"


def test_decoding(spark):
    df = spark.createDataFrame([("/a%20b+c%zz%2e",), ("%E4%B8%ADx",), ("100%",)], "c string")
    assert [r[0] for r in df.select(T.percent_decoded(F.col("c"))).collect()] == ["/a b+c%zz.", "中x", "100%"]


@pytest.mark.parametrize(
    ("row", "technique"),
    [
        (web("1.1.1.1", "/search?q=union%20select%201", 200), "T1190"),
        (web("1.1.1.1", "/", 200, ua="${jndi:ldap://x}"), "T1190"),
        (web("1.1.1.1", "/run?c=1;cat%20/x", 200), "T1190"),
        (web("1.1.1.1", "/", 404, ua="gobuster/3.1"), "T1595.002"),
        (web("1.1.1.1", "/.env", 200), "T1083"),
        (web("1.1.1.1", "/.env", 404), None),
        (web("1.1.1.1", "/index", 200), None),
    ],
)
def test_web_rules(spark, row, technique):
    v = rules.rule_verdicts(units_of(access=lines(spark, [row]))).first()
    assert (v.technique, v.is_incident) == (technique, technique is not None)


def test_count_rules(spark):
    v = rules.rule_verdicts(units_of(auth=lines(spark, [ssh(i, "192.0.2.1") for i in range(13)] + [ssh(1, "192.0.2.2"), ssh(2, "192.0.2.2")])))
    assert {(r.technique, r.confidence) for r in v.collect()} == {("T1110.001", 0.75), (None, 0.5)}
    v = rules.rule_verdicts(units_of(access=lines(spark, [web("10.0.0.1", "/login", 401, "POST", second=i) for i in range(24)] + [web("10.0.0.2", f"/p{i}", 404, second=i) for i in range(35)])))
    assert {(r.technique, r.confidence) for r in v.collect()} == {("T1110", 0.8), ("T1595.002", 0.85)}


def win(code, t, host="H", ip="192.0.2.150", user="admin", **more):
    return json.dumps({"timestamp": t, "event_code": code, "host": host, "username": user, "source_ip": ip} | more)


@pytest.mark.parametrize(("at", "hit"), [("09:00:00", True), ("10:00:00", True), ("10:00:01", False), ("08:59:59", False)])
def test_account_after_failed_logons(spark, at, hit):
    rows = [win("4625", f"2026-01-10T09:{i:02d}:00+00:00") for i in range(6)] + [win("4720", f"2026-01-10T{at}+00:00", new_account="b"), "{bad"]
    v = rules.rule_verdicts(units_of(windows=lines(spark, rows))).filter("technique = 'T1136.001'").count()
    assert v == hit


def test_windows_groups(spark):
    rows = [win("4625", f"2026-01-10T09:{i:02d}:00+00:00", ip=None) for i in range(5)] + [win("4625", f"2026-01-10T09:{i:02d}:00+00:00") for i in range(4)]
    rows += [json.dumps({"timestamp": "2026-01-10T09:00:00", "event_code": 4624, "username": "u"}), win("1102", "2026-01-10T09:00:00"), "[1]", "7"]
    u = units_of(windows=lines(spark, rows)).collect()
    assert sorted(x.action for x in u) == ["logon_failure"] * 5 + ["logon_success"]
    assert [x.actor for x in u if x.raw["count"] == 5] == [None]
    missing = rules.rule_verdicts(units_of(windows=lines(spark, [json.dumps({"timestamp": "2026-01-10T09:00:00", "event_code": "4625"})] * 6 + [json.dumps({"timestamp": "2026-01-10T09:10:00", "event_code": "4720"})])))
    assert missing.filter("is_incident").count() == 0  # the burst's host reads "?", the account's is missing


def cloud(action, t, status="success", user="u", ip="198.51.100.3", **more):
    return json.dumps({"timestamp": t, "action": action, "status": status, "username": user, "source_ip": ip} | more)


@pytest.mark.parametrize(
    ("user", "ip", "at", "hit"),
    [("u", "9.9.9.9", "09:10:00", True), ("v", "198.51.100.3", "09:10:00", True), ("v", "9.9.9.9", "09:10:00", False), ("u", "198.51.100.3", "08:00:00", False), ("u", "9.9.9.9", "09:00:00", True), ("", "", "09:10:00", False)],
)
def test_iam_after_failure(spark, user, ip, at, hit):
    rows = [cloud("console_login", "2026-01-10T09:00:00+00:00", "failure"), cloud("iam_policy_changed", f"2026-01-10T{at}+00:00", user=user, ip=ip, target_user="svc")]
    assert rules.rule_verdicts(units_of(cloud=lines(spark, rows))).filter("technique = 'T1098'").count() == hit


@pytest.mark.parametrize(("port", "cidr", "confidence"), [(22, "0.0.0.0/0", 0.9), (5432, "0.0.0.0/0", 0.95), (22.9, "0.0.0.0/0", 0.9), (443, "0.0.0.0/0", None), (22, "10.0.0.0/8", None)])
def test_security_group(spark, port, cidr, confidence):
    v = rules.rule_verdicts(units_of(cloud=lines(spark, [cloud("security_group_rule_added", "2026-01-10T09:00:00Z", port=port, cidr=cidr)]))).first()
    assert v.confidence == (confidence or 0.5) and v.is_incident == (confidence is not None)


def test_numbering_both_ways(spark, tmp_path):
    u = bursts.auth_units(parse.auth_records(lines(spark, [ssh(i % 60, f"10.0.{i % 9}.{i}") for i in range(200)])))
    a = {r.id: r.actor for r in numbering.number_units_in_window(u).collect()}
    assert a == {r.id: r.actor for r in numbering.number_units(u).collect()}
    b = {r.id: r.actor for r in numbering.number_units_at_scale(u, 5, str(tmp_path / "t")).collect()}
    assert a == b and len(a) == 200 and "lx-0001" in a


def test_readers(spark, tmp_path):
    (tmp_path / "linux_auth.log").write_text(f"\n  {ssh(1, '192.0.2.1')}  \n\n")
    (tmp_path / "nginx_access.log").write_text(web("10.0.0.1", "/", 200) + "\n")
    (tmp_path / "nginx_auth_bruteforce_2.log").write_text(web("10.0.0.1", "/login", 401, "POST") + "\n")
    from sentrylake.plans.detection import detect

    units, verdicts = detect(spark, str(tmp_path))
    assert sorted(r.id for r in units.collect()) == ["lx-0001", "ng-0001", "ng-0002"] and verdicts.count() == 3
    (tmp_path / "odd.log").write_text("x\n")
    with pytest.raises(Exception, match="no log source"):
        readers.numbered_lines(spark, str(tmp_path)).select(readers.source_of(F.col("file"))).collect()


RESPONSES = [
    ('{"is_incident": true, "technique": "t1110", "confidence": 0.9, "reason": "r"}', True, "T1110", 0.9),
    ('Here:\n```json\n{"is_incident": true, "technique": "T1059", "confidence": 0.8}\n```', True, "T1059", 0.8),
    ('{"is_incident": true}', True, None, 0.5),
    ('{"is_incident": true, "technique": "T1", "confidence": 1.7}', True, "T1", 0.017),
    ('{"is_incident": "no", "technique": "T1", "confidence": "90%"}', False, None, 0.9),
    ('{"incident": "malicious", "confidence": "high", "reason": "a } b"}', True, None, 0.9),
    ("this is an attack", True, None, 0.3),
    ("", False, None, 0.2),
    (None, False, None, 0.2),
    ("   ", False, None, 0.2),
    ("{not valid json}", False, None, 0.2),
    ('{"is_incident": true, "confidence":', True, None, 0.3),
    ("null", False, None, 0.2),
    ("not an incident, no attack", False, None, 0.2),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RESPONSES)], "i int, response string")
    got = {r.i: (r.is_incident, r.technique, round(r.confidence, 6)) for r in responses.parse_responses(df).collect()}
    assert [got[i] for i in range(len(RESPONSES))] == [r[1:] for r in RESPONSES]


def test_response_store(spark, tmp_path):
    u = units_of(auth=lines(spark, [ssh(1, "192.0.2.1"), ssh(1, "192.0.2.2")]))
    asked = responses.prompts(u, {"v1": "{event}"}, "p", "m")
    with pytest.raises(LookupError):
        responses.classify(asked, spark.createDataFrame([], "key string, response string"))
    new = responses.respond(asked, lambda texts: ['{"is_incident": true}' for _ in texts])
    writers.append_responses(None, new, str(tmp_path))
    stored = readers.stored_responses(spark, str(tmp_path))
    writers.append_responses(stored, new, str(tmp_path))
    stored = readers.stored_responses(spark, str(tmp_path))
    assert stored.count() == 2 and responses.missing(asked, stored).count() == 0
    assert responses.classify(asked, stored).filter("is_incident").count() == 2


def predictions(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], "run_key string, line_no long, unit_id string, is_incident boolean, technique string")


def test_scores_by_hand(spark):
    truth = [("incident", "T1")] * 5 + [("benign", None)] * 5
    labels = spark.createDataFrame([(f"u{i}", "s", *t) for i, t in enumerate(truth)], "unit_id string, source string, label string, technique string")
    rows = [("u0", False, None), ("u0", True, "t1"), ("u1", True, "T2"), ("u2", True, None), ("u5", True, "T1"), ("u6", False, None), ("zz", True, None)]
    s = scoring.scores(scoring.judged(labels, predictions(spark, rows))).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.n_missing) == (3, 1, 2, 4, 5)
    assert s.precision == 0.75 and s.recall == 0.6 and round(s.f1, 4) == 0.6667 and s.fp_per_1000 == 100 and round(s.technique_accuracy, 4) == 0.3333
    with pytest.raises(ValueError, match="no prediction"):
        scoring.judged(labels, predictions(spark, rows), strict=True)


def test_hybrid_and_drift(spark):
    kind = "unit_id string, is_incident boolean, technique string, confidence double, reason string"
    r = spark.createDataFrame([("a", True, "T1", 0.9, "x"), ("b", False, None, 0.5, ""), ("c", False, None, 0.5, "")], kind)
    m = spark.createDataFrame([("a", False, None, 0.1, "y"), ("b", True, "T2", 0.7, " z ")], kind)
    got = {x.unit_id: (x.is_incident, x.technique, x.reason) for x in hybrid.combined(r, m).collect()}
    assert got == {"a": (True, "T1", "[hybrid:rules] x"), "b": (True, "T2", "[hybrid:llm] z"), "c": (False, None, "[hybrid:llm]")}
    assert scoring.drift(r, r).count() == 0 and scoring.drift(r, m).count() == 3


def test_examples_spread_over_sources(spark):
    df = spark.createDataFrame([("c", "s1", f"u{i}") for i in range(4)] + [("c", "s2", "u9")], "class string, source string, unit_id string")
    assert [r.unit_id for r in disagree.diverse(df, 3, "class").orderBy("pick").collect()] == ["u0", "u9", "u1"]


def test_labels(spark):
    rows = [ssh(i, "192.0.2.100") for i in range(3)] + [ssh(1, "8.8.8.8"), "Jan 10 09:00:01 h sshd[1]: Accepted password for d from 203.0.113.99 port 5 ssh2"]
    got = {(r.event.actor, r.technique) for r in labelling.assembled(labelling.label_auth(parse.auth_records(lines(spark, rows)))).collect()}
    assert got == {("192.0.2.100", "T1110.001"), ("8.8.8.8", None), ("203.0.113.99", "T1078")}
    rows = [win("4625", "2026-01-10T09:00:00Z", host="WIN-SERVER01"), win("4688", "2026-01-10T09:00:00Z", command_line="powershell -Enc x"), win("4688", "2026-01-10T09:00:00Z", command_line="certutil -urlcache"), win("4720", "2026-01-10T09:00:00Z"), win("4624", "2026-01-10T09:00:00Z")]
    got = sorted(str(r.technique) for r in labelling.label_windows(readers.json_records(lines(spark, rows))).collect())
    assert got == ["None", "T1059.001", "T1105", "T1110.001", "T1136.001"]
    rows = [cloud("console_login", "2026-01-10T09:00:00Z", "failure"), cloud("iam_policy_changed", "2026-01-09T09:00:00Z"), cloud("security_group_rule_added", "2026-01-10T09:00:00Z", port=22, cidr="0.0.0.0/0"), cloud("odd", "2026-01-10T09:00:00Z")]
    got = sorted(str(r.technique) for r in labelling.label_cloud(readers.json_records(lines(spark, rows))).collect())
    assert got == ["None", "T1098", "T1562.007"]
    rows = [web("198.51.100.77", f"/p{i}", 404) for i in range(3)] + [web("7.7.7.7", f"/p{i}", 404) for i in range(20)] + [web("6.6.6.6", "/../x", 200), web("6.6.6.6", "/", 200)]
    got = sorted(str(r.technique) for r in labelling.label_access(parse.access_records(lines(spark, rows))).collect())
    assert got == ["None", "None", "T1190", "T1595.002"]


def test_heuristic_is_total(spark):
    u = units_of(auth=lines(spark, [ssh(i, "192.0.2.1") for i in range(8)]), access=lines(spark, [web("1.1.1.1", "/.env", 404)]))
    assert {r.technique for r in heuristic.heuristic_verdicts(u).collect()} == {"T1110.001", "T1083"}


def test_evidence(spark):
    u = units_of(auth=lines(spark, [ssh(i, "192.0.2.1", f"u{i}") for i in range(8)]))
    text = u.select(T.evidence(F.struct("id", *[c for c in UNIT_FIELDS if c != "line_no"]))).first()[0]
    assert text.startswith("source: linux_auth\naction: ssh_failed_password\nactor: 192.0.2.1\n") and "count: 8" in text
    assert "targets: u0, u1, u2, u3, u4, u5, ... (+2 more)" in text and "window: 2026-01-10T09:00:00+00:00 .. 2026-01-10T09:07:00+00:00" in text and text.count("  - ") == 4


def test_no_nested_loops_in_correlations(spark):
    u = units_of(windows=lines(spark, [win("4720", "2026-01-10T09:00:00Z")]), cloud=lines(spark, [cloud("iam_policy_changed", "2026-01-10T09:00:00Z")]))
    plan = rules.rule_verdicts(u)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


ROW = {"unit_id": "a", "event": {"id": "a", "source": "linux_auth", "action": "x", "raw": {}}, "label": "benign"}


@pytest.mark.parametrize(
    ("row", "what"),
    [(ROW | {"odd": 1}, "unknown field odd"), (ROW | {"event": ROW["event"] | {"odd": 1}}, "unknown field of an event odd"), (ROW | {"event": ROW["event"] | {"action": "  "}}, "empty action"), (ROW | {"event": ROW["event"] | {"source": "x"}}, "unknown source"), (ROW | {"label": "bad"}, "unknown label"), (ROW, None)],
)
def test_strict_labels(spark, tmp_path, row, what):
    (tmp_path / "l.json").write_text(json.dumps(row) + "\n")
    if what is None:
        assert readers.labelled_units(spark, str(tmp_path / "l.json")).first().event.action == "x"
    else:
        with pytest.raises(Exception, match=what):
            readers.labelled_units(spark, str(tmp_path / "l.json")).collect()


def test_responses_that_break_parsers(spark):
    texts = ["{" * 5000 + "}" * 5000, '{"a": ' * 300000 + "1" + "}" * 300000, '{"is_incident": true, "confidence": ' + "9" * 400 + "}", '{"is_incident": true, "reason": "\\ud800 x", "technique": "\\udfff"}', '{"is_incident": [1], "confidence": -1e999}', 'said "{" then {"is_incident": "yes"}', '"open \\']
    got = [tuple(r) for r in responses.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")).orderBy("i").select("is_incident", "confidence").collect()]
    assert got == [(False, 0.2), (False, 0.2), (True, 1.0), (True, 0.5), (True, 0.0), (True, 0.5), (False, 0.2)]


def test_plan_of_the_rules_is_small(spark):
    u = units_of(auth=lines(spark, [ssh(1, "192.0.2.1")]), access=lines(spark, [web("1.1.1.1", "/", 200)]))
    plan = rules.rule_verdicts(u).filter("is_incident")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000


def test_distinct_targets_stand_in_for_users(spark):
    df = spark.range(1).select(F.struct(*[F.lit("x").alias(c) for c in ("id", "source", "actor", "action", "target", "status")], raw(distinct_targets=F.array(F.lit("a"), F.lit("b"))).alias("raw")).alias("u"))
    assert "targets: a, b" in df.select(T.evidence(F.col("u"))).first()[0]


def test_strict_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text("")
    with pytest.raises(ValueError, match="no labelled units"):
        readers.labelled_units(spark, str(tmp_path / "l.json"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "rules.jsonl").write_text('{"unit_id": "a", "is_incident": true, "technique": "T1"}\n')
    assert readers.prediction_runs(spark, str(tmp_path / "p")).first().run_key == "rules"
    writers.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "csv")).count() == 2
    assert LABELED and raw and RuleConfig and ShapeConfig and correlate
