from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import AUTH_LOG, BURST, T0, event, events_frame, lines_frame
from palisade import detect
from palisade.operators import report
from palisade.operators.correlate import correlate
from palisade.operators.enrich import enrich, enrich_geo, ip_number
from palisade.operators.filters import (
    at_least, event_columns, filter_events, flat_findings, without_info,
)
from palisade.plans.storage import stored
from palisade.schema import normalise_events
from palisade.sources.syslog import parse_syslog
from test_correlate import finding, found_of


@pytest.fixture(scope="module")
def events(spark):
    return stored(parse_syslog(lines_frame(spark, AUTH_LOG), 2024))


@pytest.fixture(scope="module")
def case(events):
    got = correlate(detect(events))
    return stored(got.findings), stored(got.evidence)


def test_event_filters(events):
    assert filter_events(events, severity="error").count() == 23
    assert filter_events(events, severity="nonsense").count() == 32
    assert filter_events(events, severity="HIGH").count() == 0
    assert filter_events(events, keyword="FAILED PASSWORD").count() == 23
    assert filter_events(events, keyword="failed password", event_type="AUTH_FAILURE", limit=3).count() == 3
    first = filter_events(events, limit=2).collect()
    assert [r.event_id for r in first] == [2, 3]
    assert filter_events(events, limit=0).count() == 32
    assert event_columns(events).columns[:3] == ["event_type", "severity", "ts"]
    assert len(event_columns(events, csv=True).columns) == 8


def test_normalise(spark):
    rows = [event(1, severity="warn"), event(2, severity="info")]
    got = normalise_events(events_frame(spark, rows)).orderBy("event_id").collect()
    assert [r.severity for r in got] == ["UNKNOWN", "INFO"]
    with pytest.raises(Exception, match="unknown event type"):
        normalise_events(events_frame(spark, [event(1, kind="odd")])).collect()


def test_finding_filters(case):
    findings, _ = case
    assert at_least(findings, "critical").count() == 5
    assert at_least(findings, "HIGH").count() == 8
    assert at_least(findings, "MEDIUM").count() == 10
    assert at_least(findings, "whatever").count() == 12
    assert without_info(findings).count() == 10
    flat = flat_findings(findings)
    assert len(flat.columns) == 10
    row = flat.filter("rule_id = 'brute_force' and event_count = 14").first()
    assert row.users == "git;mail;nora;pilot;root;svc;www" and row.source_ips == BURST


def test_order_and_listing(case):
    findings, _ = case
    order = [r.severity for r in report.ranked(findings).collect()]
    assert order == ["CRITICAL"] * 5 + ["HIGH"] * 3 + ["MEDIUM"] * 2 + ["INFO"] * 2
    ids = [r.finding_id for r in report.ranked(findings).collect()]
    nr = report.numbered(findings).orderBy("nr").collect()
    assert [r.nr for r in nr] == list(range(1, 13)) and [r.finding_id for r in nr] == ids
    assert report.listing(findings).columns == ["nr", "severity", "rule_id", "title", "event_count"]


def test_numbering_without_times(spark):
    rows = [finding("x", None, fid=f"f{i}") for i in range(5)] + [finding("x", 3, fid="g")]
    got = report.numbered(found_of(spark, rows).findings).orderBy("nr").collect()
    assert [(r.nr, r.finding_id) for r in got] == [(1, "g"), *[(i + 2, f"f{i}") for i in range(5)]]


def test_summary(case):
    r = report.summary(*case).first()
    assert (r.total_findings, r.critical, r.high, r.medium, r.low, r.correlated) == (12, 5, 3, 2, 0, 4)
    assert (r.n_source_ips, r.n_users) == (3, 8)
    assert r.status == "CRITICAL — immediate action required"
    assert report.names(*case).filter("kind = 'ip'").count() == 3


def test_summary_of_nothing(spark, case):
    findings, evidence = case
    r = report.summary(findings.limit(0), evidence.limit(0)).first()
    assert (r.total_findings, r.evidence_events, r.status) == (0, 0, "Review recommended")


def test_timeline(case):
    rows = report.timeline(*case).collect()
    times = [r.ts for r in rows]
    assert times == sorted(times)
    kinds = {k: sum(r.kind == k for r in rows) for k in ("finding", "correlated", "event")}
    # 14 + 7 failed logins, 2 logins, 2 commands as root, 1 new account
    assert kinds == {"finding": 8, "correlated": 4, "event": 26}
    assert rows[0].kind == "correlated" and rows[0].action == "Login followed by privilege escalation"
    short = report.timeline(*case, detail_chars=20).collect()
    assert max(len(r.detail) for r in short) == 20


def test_timeline_keys(spark):
    rows = [event(i, sec=s, raw=raw, message=m, ip=None, user=None, host=h) for i, (s, raw, m, h) in enumerate([
        (0, "same", "a", "h"), (0, "same", "b", "h"), (1, "same", "a", "h"), (None, "", "x" * 130, ""),
        (None, "", "x" * 140, "")])]
    ev = events_frame(spark, rows).withColumn("finding_id", F.lit("f"))
    f = found_of(spark, [finding("r", None, (), (), fid="f")]).findings
    ev = ev.select("finding_id", *ev.columns[:-1])
    # whole texts tell events apart, unless only their beginnings are asked for
    assert report.timeline(f, ev).count() == 5
    got = report.timeline(f, ev, key_chars=120).collect()
    assert [(r.kind, r.actor, r.detail[:3]) for r in got] == [
        ("event", "h", "a"), ("event", "h", "a"), ("finding", "unknown", "d"), ("event", "unknown", "xxx")]


def test_actions(case):
    findings, _ = case
    got = report.actions(findings).orderBy("nr").collect()
    assert [r.nr for r in got] == list(range(1, len(got) + 1))
    assert got[0].severity == "CRITICAL" and got[-1].severity == "INFO"
    # the two addresses of the bursts give different beginnings, the spray and
    # the burst of one address too; the two logins share one advice
    assert len(got) == 10


def test_evidence(spark, case):
    findings, evidence = case
    lines = report.evidence_lines(findings, evidence).collect()
    assert len(lines) == len({r.raw for r in lines}) == 26
    assert lines[0].title == "Login followed by privilege escalation"
    assert report.capped_evidence(evidence, 2).groupBy("finding_id").count().agg(F.max("count")).first()[0] == 2
    rows = report.export_rows(findings, evidence, 3).collect()
    assert len(rows) == 12 and max(len(r.evidence) for r in rows) == 3
    one = next(r for r in rows if r.rule_id == "brute_force" and r.event_count == 14)
    assert one.evidence[0].timestamp == "2024-11-17 22:40:00" and "ord" not in one.evidence[0].asDict()
    s = report.evidence_summary(findings, evidence).first()
    assert s.source == "log" and s.evidence_events == evidence.count()


def test_long_titles_do_not_travel(spark):
    """A title with the names of all accounts is put on lines that are in order already."""
    rows = [event(i, "user_created", i, user=f"account{i}") for i in range(60)]
    rows += [event(100 + i, "auth_success", i, raw=f"raw {i % 3}") for i in range(5)]
    found = detect(events_frame(spark, rows))
    lines = report.evidence_lines(stored(found.findings), found.evidence)
    got = lines.collect()
    long = next(r.title for r in found.findings.collect() if r.rule_id == "priv_esc")
    assert len(long) > report.TITLE_CHARS and "account59" in long
    assert [r.raw for r in got if r.title == long] == [f"raw {i}" for i in range(60)]
    assert len(got) == 60
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join LeftOuter") < plan.find("Sort [")


def test_evidence_needs_no_peaks(spark):
    """The evidence of a detector is not computed by way of all facts of its findings."""
    rows = [event(i, sec=i, user=f"u{i % 7}", message="Invalid user x") for i in range(40)]
    rows += [event(100 + i, "sudo", i, message="authentication failure") for i in range(9)]
    evidence = detect(events_frame(spark, rows)).evidence
    assert evidence.groupBy().agg(F.count_distinct("finding_id"), F.count(F.lit(1))).first() == (4, 129)
    assert "Window" not in evidence._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_write(spark, case, tmp_path, fmt):
    findings, evidence = case
    report.write_report(findings, evidence, str(tmp_path), fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / "findings"))
    assert back.count() == 12
    assert spark.read.format(fmt).option("header", True).load(str(tmp_path / "evidence")).count() == evidence.count()


# ------------------------------------------------------------- enrichment
def test_ip_number(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("1.2.3.256",), ("x",), ("",), (None,)], "ip string")
    assert [r[0] for r in df.select(ip_number(F.col("ip"))).collect()] == [16909060, 4294967295, None, None, None, None]


def test_geo(spark):
    city = spark.createDataFrame([
        (ip(1, 0, 0, 0), ip(1, 3, 255, 255), "AA", "Aland", "", 1.0, 2.0),
        (ip(1, 4, 0, 10), ip(1, 4, 0, 20), "BB", "Bland", "Btown", 3.0, 4.0),
        (ip(1, 4, 0, 21), ip(1, 4, 0, 21), "CC", "Cland", "Ctown", 5.0, 6.0),
    ], "start_ip bigint, end_ip bigint, country string, country_name string, city string, latitude double, longitude double")
    asn = spark.createDataFrame([(ip(1, 2, 0, 0), ip(1, 2, 0, 255), 64512, "net")],
                                "start_ip bigint, end_ip bigint, asn int, asn_org string")
    ips = ["1.0.0.0", "1.2.0.7", "1.3.255.255", "1.4.0.0", "1.4.0.9", "1.4.0.10", "1.4.0.20", "1.4.0.21",
           "1.4.0.22", "host", None, "1.2.0.7"]
    events = events_frame(spark, [event(i, ip=v) for i, v in enumerate(ips)])
    got = enrich(events, lambda e: enrich_geo(e, city, asn)).orderBy("event_id").collect()
    assert [r.ip for r in got] == ips
    assert [r.geoip and r.geoip.country for r in got] == [
        "AA", "AA", "AA", None, None, "BB", "BB", "CC", None, None, None, "AA"]
    assert [r.geoip and r.geoip.asn for r in got][1:3] == [64512, None]
    assert got[9].geoip is not None and got[10].geoip is None
    assert enrich_geo(events).columns == events.columns
    assert enrich_geo(events, asn=asn).count() == 12


def ip(a, b, c, d):
    return ((a * 256 + b) * 256 + c) * 256 + d
