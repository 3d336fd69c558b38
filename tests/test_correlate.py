import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import AUTH_LOG, BURST, T0, event, lines_frame
from palisade import Params, detect
from palisade.operators.correlate import BUILT_IN_RULES, SequenceRule, chain_evidence, correlate
from palisade.operators.detection import RANKS, Detection
from palisade.plans.storage import stored
from palisade.schema import EVENTS, EVIDENCE, FINDINGS
from palisade.sources.syslog import parse_syslog


def finding(rule_id, sec, ips=("1.2.3.4",), users=("root",), fid=None, severity="HIGH"):
    return dict(
        finding_id=fid or f"{rule_id}@{sec}", finding_rank=RANKS.get(rule_id, 80), rule_id=rule_id,
        title=rule_id, severity=severity, confidence="HIGH", description="d", recommendation="r",
        first_seen=None if sec is None else T0 + timedelta(seconds=sec),
        last_seen=None if sec is None else T0 + timedelta(seconds=sec),
        event_count=max(len(ips), len(users), 1), n_source_ips=len(ips), n_users=len(users),
        source_ips=sorted(ips), users=sorted(users), is_correlated=False, correlated_rules=[],
        metadata={},
    )


def found_of(spark, findings, kept=100):
    evidence = []
    for f in findings:
        ips, users = f["source_ips"], f["users"]
        for i in range(f["event_count"]):
            e = event(len(evidence), ip=ips[i % len(ips)] if ips else None,
                      user=users[i % len(users)] if users else None)
            e["ts"] = f["first_seen"]
            evidence.append((f["finding_id"], *[e[c.name] for c in EVENTS.fields]))
    rows = []
    for f in findings:
        f = {**f, "source_ips": f["source_ips"][:kept], "users": f["users"][:kept]}
        rows.append(tuple(f[c.name] for c in FINDINGS.fields))
    return Detection(
        spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(evidence, EVIDENCE)
    )


def chains(spark, findings, rules=BUILT_IN_RULES, mode="reference", kept=100, window=3600):
    got = correlate(
        found_of(spark, findings, kept),
        Params(correlation_window_sec=window, names_kept=kept), rules, mode,
    )
    out = got.findings.filter("is_correlated")
    return out.select("rule_id", "correlated_rules", F.col("metadata")["triggered_by"].alias("by"),
                      "n_source_ips", "n_users", "finding_id").collect()


# ------------------------------------------------- a sequential model to compare
class Arrived:
    def __init__(self, f, parts=None):
        self.f, self.rule_id, self.time = f, f["rule_id"], f["first_seen"]
        self.members = parts if parts is not None else ({("ip", v) for v in f["source_ips"]} | {("user", v) for v in f["users"]})
        self.fid = f["finding_id"]


def model(findings, rules, window):
    order = sorted(findings, key=lambda f: (
        f["first_seen"] is None, f["first_seen"] or T0, f["finding_rank"], f["finding_id"]))
    live, fired, out = [], set(), []
    for arrival in map(Arrived, order):
        while arrival.time and live and live[0].time and live[0].time < arrival.time - timedelta(seconds=window):
            live.pop(0)
        live.append(arrival)
        for rule in rules:
            hits = []
            for step in rule.steps:
                hits.append(next((x for x in live if x.rule_id in step and x not in hits), None))
            if None in hits:
                continue
            members = set().union(*[h.members for h in hits])
            key = (rule.rule_id, tuple(sorted(v for _, v in members)))
            if key in fired:
                continue
            fired.add(key)
            times = [h.time for h in hits if h.time]
            chain = Arrived({"rule_id": rule.rule_id, "finding_id": None,
                             "first_seen": min(times, default=None)}, members)
            chain.fid = "|".join([rule.rule_id, *[h.fid for h in hits]])
            live.append(chain)
            out.append((rule.rule_id, chain.fid, arrival.fid,
                        sum(k == "ip" for k, _ in members), sum(k == "user" for k, _ in members)))
    return sorted(out)


def random_findings(seed, cases=60):
    rnd = random.Random(seed)
    out, base = [], 0
    for case in range(cases):
        for i in range(rnd.randint(2, 9)):
            rule = rnd.choice(list(RANKS))
            sec = base + rnd.choice([0, 0, 5, rnd.randint(0, 250)])
            ips = rnd.sample(["a", "b", f"c{case}"], rnd.randint(0, 2))
            users = rnd.sample(["a", "x", f"y{case}", f"z{case}"], rnd.randint(0, 3))
            out.append(finding(rule, sec, ips, users, fid=f"{rule}|{case}.{i}"))
        base += rnd.choice([90, 150, 400])
    return out


@pytest.mark.parametrize("seed,kept", [(1, 100), (2, 1), (3, 100)])
def test_equals_sequential_model(spark, seed, kept):
    findings = random_findings(seed)
    if seed == 3:
        findings += [finding(r, None, ("q",), (f"n{i}",), fid=f"{r}|n{i}")
                     for i, r in enumerate([*RANKS, "enumeration", "auth_success"])]
    got = sorted((r.rule_id, r.finding_id, r.by, r.n_source_ips, r.n_users)
                 for r in chains(spark, findings, kept=kept, window=100))
    want = model(findings, BUILT_IN_RULES, 100)
    assert len(want) > 60
    assert got == want


def test_user_rules_with_shared_steps(spark):
    rules = (
        SequenceRule("two", "t", (("brute_force", "enumeration"), ("enumeration",)), 60, "HIGH", "HIGH"),
        SequenceRule("three", "t", (("enumeration",),) * 3, 60, "HIGH", "HIGH"),
        SequenceRule("late", "t", (("two",), ("three",), ("auth_success",)), 60, "HIGH", "HIGH"),
    )
    findings = random_findings(7, 40)
    got = sorted((r.rule_id, r.finding_id) for r in chains(spark, findings, rules, window=100))
    want = model(findings, rules, 100)
    # a chain that reads chains is placed right behind what triggered them
    assert [g for g in got if g[0] != "late"] == [w[:2] for w in want if w[0] != "late"]
    assert {"two", "three"} <= {g[0] for g in got}


def test_rule_with_conditions(spark):
    rule = SequenceRule("c", "t", (F.col("severity") == "CRITICAL", F.col("n_users") > 1), 60, "HIGH", "LOW")
    got = chains(spark, [finding("a", 0, severity="CRITICAL"), finding("b", 5, users=("x", "y"))], (rule,))
    assert [r.finding_id for r in got] == ["c|a@0|b@5"]
    assert chains(spark, [finding("a", 0, users=("x", "y"), severity="CRITICAL")], (rule,)) == []


def test_partial_match_and_pass_through(spark):
    got = correlate(found_of(spark, [finding("brute_force", 0), finding("brute_force", 10)]))
    assert got.findings.count() == 2 and got.links.count() == 0 and got.evidence.count() == 2


def test_window_is_closed(spark):
    pair = lambda gap: [finding("brute_force", 0), finding("auth_success", gap)]
    assert len(chains(spark, pair(100), window=100)) == 1
    assert len(chains(spark, pair(101), window=100)) == 0


def test_circle_is_an_error(spark):
    rules = (SequenceRule("a", "t", (("b",),), 1, "HIGH", "HIGH"), SequenceRule("b", "t", (("a",),), 1, "HIGH", "HIGH"))
    with pytest.raises(ValueError):
        chains(spark, [finding("x", 0)], rules)


def test_scenario(spark):
    events = stored(parse_syslog(lines_frame(spark, AUTH_LOG), 2024))
    got = correlate(detect(events))
    rows = got.findings.filter("is_correlated").orderBy("rule_id", "finding_id").collect()
    assert [(r.rule_id, r.severity) for r in rows] == [
        ("brute_then_success", "CRITICAL"), ("full_attack_chain", "CRITICAL"),
        ("success_then_priv_esc", "CRITICAL"), ("success_then_priv_esc", "CRITICAL")]
    brute, full, priv, own = rows
    assert brute.correlated_rules == ["brute_force", "auth_success"]
    assert brute.source_ips == [BURST] and brute.event_count == 15
    assert brute.n_users == 7 and brute.title == "Brute force succeeded"
    assert full.correlated_rules == ["brute_force", "auth_success", "priv_esc"]
    assert priv.users == ["svc"] and own.users == ["nora"] and priv.metadata["window_sec"] == "1800"
    assert got.findings.count() == 12
    assert got.findings.filter("severity != 'INFO'").count() == 10
    chain = got.evidence.filter(F.col("finding_id") == brute.finding_id)
    assert chain.count() == 15
    three = chain_evidence(got.links, detect(events).evidence, 3)
    assert three.filter(F.col("finding_id") == full.finding_id).count() == 3


# ------------------------------------------------------------------- keyed
def keyed(spark, findings, *only):
    rules = tuple(r for r in BUILT_IN_RULES if not only or r.rule_id in only)
    return sorted(r.finding_id for r in chains(spark, findings, rules, "keyed"))


def test_keyed_needs_same_source_and_order(spark):
    rows = [finding("brute_force", 0, ("a",), fid="b1"), finding("auth_success", 100, ("a",), ("u",), fid="s1"),
            finding("auth_success", 50, ("z",), ("u",), fid="s2"), finding("auth_success", 200, ("a",), ("u",), fid="s3"),
            finding("brute_force", 300, ("z",), fid="b2"), finding("brute_force", 0, ("w",), fid="b3"),
            finding("auth_success", 601, ("w",), ("u",), fid="s4")]
    assert keyed(spark, rows, "brute_then_success") == ["brute_then_success|b1|s1"]
    rows[-1] = finding("auth_success", 600, ("w",), ("u",), fid="s4")
    assert keyed(spark, rows, "brute_then_success") == ["brute_then_success|b1|s1", "brute_then_success|b3|s4"]


def test_keyed_chain_and_recon(spark):
    rows = [finding("password_spray", 0, ("a",), ("u", "v"), fid="p"),
            finding("auth_success", 10, ("a",), ("u",), fid="s"),
            finding("priv_esc", 20, (), ("u", "v"), fid="e"), finding("priv_esc", 30, (), ("u",), fid="e2"),
            finding("enumeration", 0, ("r",), (), fid="n1"), finding("enumeration", 3600, ("r",), (), fid="n2"),
            finding("enumeration", 0, ("q",), (), fid="n3"), finding("enumeration", 3601, ("q",), (), fid="n4"),
            finding("brute_force", 1800, ("r",), (), fid="b")]
    assert keyed(spark, rows) == [
        "brute_then_success|p|s", "enum_then_brute|n1|b", "full_attack_chain|p|s|e",
        "persistent_recon|n1|n2", "success_then_priv_esc|s|e"]
