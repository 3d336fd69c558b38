from fixtures import AUTH_LOG, BURST, LATE_BURST, T0, event, events_frame, lines_frame
from palisade import Params, detect
from palisade.operators.accounts import auth_success, priv_esc
from palisade.operators.allow import split_allowlist
from palisade.operators.sources_of_attack import brute_force, enumeration, password_spray
from palisade.sources.syslog import parse_syslog


def run(spark, detector, rows, **params):
    found = detector(events_frame(spark, rows), Params(**params))
    return found.findings.orderBy("finding_rank", "finding_id").collect(), found.evidence


def fails(n, ip="1.2.3.4", step=1, start=0, user="root", i0=0):
    return [event(i0 + i, sec=start + i * step, ip=ip, user=user) for i in range(n)]


# ------------------------------------------------------------ brute force
def test_brute_force(spark):
    (f,), evidence = run(spark, brute_force, fails(10))
    assert (f.rule_id, f.severity, f.confidence, f.event_count) == ("brute_force", "HIGH", "HIGH", 10)
    assert f.title == "Brute force attack from 1.2.3.4"
    assert f.description == (
        "1.2.3.4 made 10 failed login attempt(s), with a peak burst of 10 within 30 minutes. "
        "Targeted account(s): root.")
    assert f.source_ips == ["1.2.3.4"] and f.users == ["root"]
    assert f.first_seen == T0 and f.metadata["burst_start"] == str(T0)
    assert f.metadata["total"] == f.metadata["burst_count"] == "10"
    assert evidence.count() == 10


def test_brute_force_levels(spark):
    got, _ = run(
        spark, brute_force,
        fails(20, ip="a") + fails(4, ip="b", i0=100) + fails(6, ip="c", step=3600, i0=200)
        + fails(15, ip="d", i0=300) + fails(14, ip="e", i0=400) + fails(9, ip=None, i0=500)
        + fails(9, ip="", i0=600)
        + [event(700 + i, kind="auth_success", sec=i, ip="g") for i in range(9)],
    )
    assert {f.source_ips[0]: (f.severity, f.confidence) for f in got} == {
        "a": ("CRITICAL", "HIGH"), "c": ("MEDIUM", "MEDIUM"), "d": ("CRITICAL", "HIGH"),
        "e": ("HIGH", "HIGH"),
    }


def test_brute_force_untimed(spark):
    rows = [event(i, sec=None) for i in range(6)] + [event(10 + i, sec=None, ip="m") for i in range(16)]
    rows += [event(40 + i, sec=i * 10, ip="m") for i in range(3)]
    got, _ = run(spark, brute_force, rows)
    a, m = got
    assert (a.severity, a.first_seen, a.metadata["burst_count"], a.metadata["burst_start"]) == ("HIGH", None, "6", None)
    assert (m.severity, m.event_count, m.metadata["burst_count"]) == ("MEDIUM", 19, "3")


def test_brute_force_window_is_closed(spark):
    rows = fails(4) + [event(9, sec=1800)]
    (f,), _ = run(spark, brute_force, rows)
    assert f.metadata["burst_count"] == "5" and f.severity == "HIGH"
    (f,), _ = run(spark, brute_force, fails(4) + [event(9, sec=1801)])
    assert f.metadata["burst_count"] == "4" and f.severity == "MEDIUM"


def test_brute_force_more_users(spark):
    rows = [event(i, sec=i, user=f"u{i:03d}") for i in range(120)]
    (f,), _ = run(spark, brute_force, rows)
    assert f.description.endswith("Targeted account(s): u000, u001, u002, u003, u004 (+115 more).")
    assert f.n_users == 120 and len(f.users) == 120


def test_brute_force_allowlist(spark):
    rows = fails(10, ip="a") + fails(10, ip="b", i0=50)
    got, _ = run(spark, brute_force, rows, allowed_ips=("a",))
    assert [f.source_ips for f in got] == [["b"]]
    table = spark.createDataFrame([("b",)], "ip string")
    got, _ = run(spark, brute_force, rows, allowed_ips=table)
    assert [f.source_ips for f in got] == [["a"]]


# ------------------------------------------------------------------ spray
def spray(n, ip="5.5.5.5", step=1, i0=0, message="x", start=0):
    return [event(i0 + i, sec=start + i * step, ip=ip, user=f"user{i:03d}", message=message)
            for i in range(n)]


def test_spray(spark):
    got, evidence = run(
        spark, password_spray,
        spray(12, "a") + spray(6, "b", i0=100) + spray(4, "c", i0=200)
        + fails(20, "d", i0=300) + fails(20, "e", user=None, i0=400) + spray(12, "f", step=100, i0=500),
    )
    levels = {f.source_ips[0]: (f.severity, f.confidence, f.n_users) for f in got}
    assert levels == {"a": ("HIGH", "HIGH", 12), "b": ("MEDIUM", "MEDIUM", 6)}
    a = got[0]
    assert a.description == (
        "a targeted 12 distinct account(s) with 12 attempt(s) within 5 minutes — consistent with a "
        "password spray attack. Accounts targeted: user000, user001, user002, user003, user004, "
        "user005, user006, user007 (+4 more).")
    assert a.metadata["distinct_users"] == "12"
    assert evidence.count() == 18


def test_spray_evidence_is_best_window(spark):
    rows = spray(6, "a", start=0) + spray(8, "a", i0=50, start=1000) + fails(3, "a", start=1001, user="user001", i0=90)
    (f,), evidence = run(spark, password_spray, rows)
    assert (f.n_users, f.event_count) == (8, 11)
    assert (f.first_seen - T0).seconds == 1000 and evidence.count() == 11


def test_spray_untimed(spark):
    rows = [event(i, sec=None, user=f"u{i}") for i in range(11)]
    rows += [event(50 + i, sec=None, user=f"u{i}", ip="m") for i in range(11)] + [event(80, sec=0, ip="m")]
    (f,), evidence = run(spark, password_spray, rows)
    assert (f.severity, f.n_users, f.source_ips, f.first_seen) == ("HIGH", 11, ["1.2.3.4"], None)
    assert evidence.count() == 11


# ------------------------------------------------------------ enumeration
def test_enumeration(spark):
    bad = "Invalid user x from y"
    rows = spray(12, "a", message=bad) + spray(8, "b", message="No Such User", i0=100)
    rows += spray(3, "c", message=bad, i0=200) + spray(20, "d", message="Failed password", i0=300)
    rows += spray(6, "e", message="user unknown", i0=400) + [event(450, ip="e", user=None, message=bad, sec=-5)]
    got, _ = run(spark, enumeration, rows)
    assert {f.source_ips[0]: (f.severity, f.confidence, f.n_users, f.event_count) for f in got} == {
        "a": ("HIGH", "HIGH", 12, 12), "b": ("MEDIUM", "MEDIUM", 8, 8), "e": ("MEDIUM", "MEDIUM", 6, 7),
    }
    assert "12 non-existent username(s)" in got[0].description and "(+2 more)" in got[0].description


# --------------------------------------------------------------- priv esc
def sudo(i, command, user="deploy", **other):
    return event(i, kind="sudo", sec=i, ip=None, user=user, process="sudo",
                 message=f"{user} : TTY=x ; COMMAND={command}", **other)


def test_priv_esc_sudo(spark):
    rows = [sudo(1, "/bin/bash"), sudo(2, "/usr/bin/systemctl"), sudo(3, "/usr/bin/CAT /etc/SHADOW", "bob"),
            sudo(4, "/bin/shutdown now")]
    (high, normal), evidence = run(spark, priv_esc, rows)
    assert (high.severity, high.confidence, high.title, high.event_count) == (
        "CRITICAL", "HIGH", "High-risk sudo command executed", 3)
    assert high.description == (
        "User(s) bob, deploy executed high-risk sudo command(s) that indicate privilege abuse or "
        "potential post-compromise activity: /bin/bash; /usr/bin/CAT /etc/SHADOW; /bin/shutdown now.")
    assert (normal.severity, normal.title) == ("MEDIUM", "Sudo activity — 1 command(s)")
    assert evidence.count() == 4


def test_priv_esc_more_commands(spark):
    (f,), _ = run(spark, priv_esc, [sudo(i, f"curl {i}") for i in range(8)])
    assert ": curl 0; curl 1; curl 2; curl 3; curl 4 (+3 more)." in f.description


def test_priv_esc_failed_sudo(spark):
    def failed(i, user, text="authentication failure"):
        return event(i, kind="sudo", sec=i, ip=None, user=user, message=f"{user} : {text}")
    rows = [failed(i, "bob") for i in range(5)] + [failed(10 + i, "eve") for i in range(2)]
    rows += [failed(20 + i, "joe", "3 Incorrect password attempts ; COMMAND=/bin/sh") for i in range(3)]
    rows += [failed(30 + i, None) for i in range(4)]
    (a, b), evidence = run(spark, priv_esc, rows)
    assert (a.title, a.severity, a.metadata["failed_count"]) == ("Repeated failed sudo attempts by bob", "HIGH", "5")
    assert b.users == ["joe"] and evidence.count() == 8


def test_priv_esc_su_and_accounts(spark):
    rows = [event(1, "su", user="root"), event(2, "su", user="bob"),
            event(3, "user_created", user="x", sec=9), event(4, "user_created", user="y", sec=5),
            event(5, "user_created", user="x", sec=20), event(6, "user_created", user=None),
            event(7, "group_change", user="wheel")]
    su, new, group = run(spark, priv_esc, rows)[0]
    assert (su.title, su.severity, su.confidence) == ("User switching via su to root", "HIGH", "MEDIUM")
    assert su.description.endswith("account(s): bob, root. Switching to root is high-risk and warrants immediate review.")
    assert new.title == "New user account created: y, x, x"
    assert new.description.startswith("4 new user account(s) created: y, x, x.") and new.severity == "HIGH"
    assert (group.title, group.confidence) == ("Group membership changed (1 event(s))", "MEDIUM")
    (su,) = run(spark, priv_esc, [event(1, "su", user="bob"), event(2, "su", user="al")])[0]
    assert (su.title, su.severity, su.description) == (
        "User switching via su to al, bob", "MEDIUM", "su was used to switch to account(s): al, bob. ")


def test_priv_esc_allowlist_and_split(spark):
    rows = [sudo(1, "/bin/bash", "nagios"), sudo(2, "ls", "bob"), sudo(3, "ls", "eve"), event(4, "su", user=None)]
    got, _ = run(spark, priv_esc, rows, allowed_users=("nagios",))
    assert [f.title for f in got] == ["Sudo activity — 2 command(s)", "User switching via su to "]
    got, _ = run(spark, priv_esc, rows, priv_esc_per=("user",))
    assert [f.users for f in got] == [["nagios"], ["bob"], ["eve"], []]


# ----------------------------------------------------------- auth success
def test_auth_success(spark):
    rows = [event(i, "auth_success", user=u, ip=p) for i, (u, p) in enumerate(
        [("deploy", "1.1.1.1"), (None, None), ("nagios", "2.2.2.2"), ("x", "9.9.9.9"), ("", "")])]
    rows.append(event(9))
    got, evidence = run(spark, auth_success, rows, allowed_users=("nagios",), allowed_ips=("9.9.9.9",))
    a, b, c = got
    assert (a.title, a.severity, a.confidence) == ("Successful login: deploy from 1.1.1.1", "INFO", "HIGH")
    assert a.users == ["deploy"] and a.n_source_ips == 1
    assert b.title == "Successful login: unknown from unknown" and b.source_ips == [] and b.n_users == 0
    assert c.users == [] and evidence.count() == 3


# ------------------------------------------------------ pipeline, allowlist
def test_scenario(spark):
    events = parse_syslog(lines_frame(spark, AUTH_LOG), 2024)
    got = detect(events).findings.orderBy("finding_rank", "finding_id").collect()
    assert [(f.rule_id, f.severity, f.event_count) for f in got] == [
        ("brute_force", "HIGH", 7), ("brute_force", "HIGH", 14), ("password_spray", "MEDIUM", 14),
        ("priv_esc", "CRITICAL", 1), ("priv_esc", "MEDIUM", 1), ("priv_esc", "HIGH", 1),
        ("auth_success", "INFO", 1), ("auth_success", "INFO", 1),
    ]
    only = detect(events, rules=["brute_force"]).findings
    assert {r.rule_id for r in only.collect()} == {"brute_force"}


def test_additional_detector(spark):
    def quiet(events, params):
        return auth_success(events.limit(0), params)
    events = events_frame(spark, fails(6))
    assert detect(events, rules=["quiet"], detectors={"quiet": quiet}).findings.count() == 0


def test_allowlist_of_findings(spark):
    events = parse_syslog(lines_frame(spark, AUTH_LOG), 2024)
    found = detect(events)
    ips, users = (BURST, LATE_BURST), ("svc", "ghost", "nora")

    def check(p):
        kept, suppressed = split_allowlist(found.findings, found.evidence, p)
        assert sorted(r.finding_id for r in kept.collect()) == ["auth_success|2", "priv_esc|normal_sudo"]
        reasons = {r.finding_id: r.reason for r in suppressed.collect()}
        assert len(reasons) == 6
        assert reasons[f"brute_force|{LATE_BURST}"] == f"all source IPs allowlisted: {LATE_BURST}"
        assert reasons["priv_esc|high_risk_sudo"] == "all targeted users allowlisted: svc"

    check(Params(allowed_ips=ips, allowed_users=users[:2]))
    check(Params(allowed_ips=ips, allowed_users=users[:2], names_kept=1))
    table = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    check(Params(allowed_ips=table(ips), allowed_users=table(users[:2])))
    kept, suppressed = split_allowlist(found.findings, found.evidence, Params())
    assert kept.count() == 8 and suppressed.count() == 0
    part = Params(allowed_users=("root", "admin"))
    kept, suppressed = split_allowlist(found.findings, found.evidence, part)
    assert [r.finding_id for r in suppressed.collect()] == [f"brute_force|{LATE_BURST}"]


def test_parameters_from_mapping():
    p = Params.from_mapping({"brute_force_threshold": 3, "allowed_ips": None,
                             "allowed_users": ["nagios"], "stream_buffer_size": 1})
    assert (p.brute_force_threshold, p.allowed_ips, p.allowed_users) == (3, (), ("nagios",))


def test_plans_have_no_python_and_no_single_task_window(spark, tmp_path):
    events_frame(spark, fails(6)).write.parquet(str(tmp_path / "e"))
    found = detect(spark.read.parquet(str(tmp_path / "e")))
    for df in (found.findings, found.evidence):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "SinglePartition" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
