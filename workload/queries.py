"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade import Params, detect
from palisade.operators import report
from palisade.operators.accounts import auth_success, priv_esc
from palisade.operators.allow import split_allowlist
from palisade.operators.correlate import BUILT_IN_RULES, SequenceRule, correlate
from palisade.operators.detection import Detection
from palisade.operators.enrich import enrich, enrich_geo
from palisade.operators.filters import (
    at_least, event_columns, filter_events, flat_findings, without_info,
)
from palisade.operators.prefixes import enrich_prefixes
from palisade.operators.sources_of_attack import brute_force, enumeration, password_spray
from palisade.operators.windows import peak_window
from palisade.plans.storage import shared_folder, stored
from palisade.schema import micros
from palisade.sources.cef import parse_cef, parse_leef
from palisade.sources.csvlog import parse_csv, read_csv
from palisade.sources.jsonlog import parse_json_documents, parse_json_lines
from palisade.sources.load import load_events, load_many, reclassify
from palisade.sources.syslog import parse_syslog
from palisade.sources.winxml import parse_windows_xml
from palisade.streaming import jobs
from palisade.streaming.findings import StreamDetection
from palisade.streaming.late import Arrivals
from workload import adapter

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400
# windows long enough for the sparse test events to give findings
WIDE = Params(brute_force_window_sec=DAY, spray_window_sec=DAY)
DAILY = Params(
    brute_force_window_sec=DAY, spray_window_sec=DAY, spray_threshold=12,
    correlation_window_sec=3 * 3600,
)
ALLOWED = Params(
    brute_force_window_sec=DAY, spray_window_sec=DAY, allowed_ips=("10.0.0.0", "10.0.1.5"),
    allowed_users=("u0", "u1"),
)


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, micros(F.col(c)))
    return df


def _event_view(events: DataFrame) -> DataFrame:
    return _micros(events, "ts").select(
        "event_id", "event_type", "severity", "ts", "host", "process", "pid", "user", "ip",
        "message", "raw",
    )


def _finding_view(findings: DataFrame, *more: Column) -> DataFrame:
    return _micros(findings, "first_seen", "last_seen").select(
        "finding_id", "rule_id", "title", "severity", "confidence", "description",
        "first_seen", "last_seen", "event_count", "n_source_ips", "n_users",
        F.array_join("source_ips", ",").alias("source_ips"),
        F.array_join("users", ",").alias("users"), *more,
    )


def _meta(name: str, kind: str = "bigint") -> Column:
    return F.col("metadata")[name].cast(kind).alias(name)


# ------------------------------------------------------------------ sources
def syslog_parse(spark, sf):
    return _event_view(adapter.log_events(spark, sf))


def syslog_parse_text(spark, sf):
    """Every line of every document, as a log whose lines have no header."""
    lines = adapter.table(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"), F.explode(F.split("text", r"\r\n|\r|\n")).alias("value")
    )
    got = parse_syslog(lines, adapter.YEAR)
    return got.groupBy("event_id", "event_type", "severity").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("message")).alias("chars")
    )


def cef_parse(spark, sf):
    got = parse_cef(adapter.cef_lines(adapter.base(spark, sf)))
    return _micros(got, "ts").select(
        "event_id", "event_type", "severity", "ts", "host", "process", "user", "ip", "message",
        F.col("metadata")["ext.msg"].alias("msg"), F.col("metadata")["sig_id"].alias("sig_id"),
    )


def leef_parse(spark, sf):
    got = parse_leef(adapter.cef_lines(adapter.base(spark, sf)))
    return got.select(
        "event_id", "event_type", "severity", "host", "process", "user", "ip", "message",
        F.col("metadata")["attrs.note"].alias("note"),
    )


def json_parse(spark, sf):
    return _event_view(parse_json_lines(adapter.json_lines(adapter.base(spark, sf))))


def json_document_parse(spark, sf):
    """One JSON array per user, as whole documents."""
    items = adapter.base(spark, sf).select(
        F.expr("event_id div 50").alias("event_id"),
        F.struct(F.col("event_id").alias("n"), F.to_json(F.struct(
            F.col("event_type").alias("msg"), F.col("user"), F.col("ip"),
            F.col("event_id").cast("string").alias("pid"),
        )).alias("j")).alias("item"),
    )
    # documents of at most 50 events each
    documents = items.groupBy("event_id").agg(F.concat(
        F.lit("["), F.array_join(F.array_sort(F.collect_list("item"))["j"], ",\n"), F.lit(", 7]")
    ).alias("value"))
    return parse_json_documents(documents).select(
        F.count("*").over(W.partitionBy("event_id")).alias("rows_of_id"), "message", "user", "ip", "pid",
        F.col("metadata")["line_number"].cast("bigint").alias("line_number"),
    )


def csv_parse(spark, sf):
    """Customers as an exported table with known and unknown columns."""
    rows = adapter.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("event_id"),
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("msg"),
        F.col("c_mktsegment").alias("service"), F.col("c_name").alias("username"),
        F.concat(F.lit("10.0.0."), F.col("c_custkey") % 256).alias("src_ip"),
        F.col("c_nationkey").cast("string").alias("extra"),
    )
    return _event_view(parse_csv(rows))


def _written_files(spark, **tables) -> str:
    """Tables of lines as folders of text files; the name says format and compression."""
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    for name, (ending, compression, rows) in tables.items():
        rows.select("value").write.text(f"{folder}/{name}{ending}", compression=compression)
    return folder


def files_load(spark, sf):
    """Log files of three formats, two of them compressed, each read by its name."""
    base = adapter.base(spark, sf)
    folder = _written_files(
        spark, auth=(".log.gz", "gzip", adapter.syslog_lines(base)), gateway=(".cef", "none", adapter.cef_lines(base)),
        app=(".jsonl.bz2", "bzip2", adapter.json_lines(base)))
    got = load_many(spark, [f"{folder}/{n}" for n in ("auth.log.gz", "gateway.cef", "app.jsonl.bz2")], year=adapter.YEAR)
    return _micros(got, "ts").select(
        F.regexp_extract("source", "/(auth|gateway|app)[.]", 1).alias("file"), "event_type", "severity", "ts", "host",
        "user", "ip", "message")


def files_ids(spark, sf):
    """Ids of log lines under two split sizes: equal, all different."""
    folder = _written_files(spark, auth=(".log", "none", adapter.syslog_lines(adapter.base(spark, sf))))
    read = lambda: load_events(spark, f"{folder}/auth.log", year=adapter.YEAR).select("event_id", "message")
    whole, known = stored(read()), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
        parts = stored(read())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
    key = ["event_id", "message"]
    given = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    both = given(whole, "in_whole").join(given(parts, "in_parts"), key, "full")
    # an id counts if either read gives it once; where the reads differ there is no number
    same = (F.col("in_whole") == 1) & (F.col("in_parts") == 1)
    return both.groupBy("message").agg(
        F.when(F.bool_and(F.coalesce(same, F.lit(False))), F.count(F.lit(1))).alias("lines"))


def files_csv(spark, sf):
    """Quoted values with line ends and quotation marks, from files that are split as other text."""
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}/customers.csv"
    name, segment, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    adapter.table(spark, sf, "customer").select(
        F.when(key % 3 == 0, F.concat(name, F.lit('\n"'), segment, F.lit('"\nend'))).otherwise(name).alias("msg"),
        name.alias("username"), F.concat(F.lit("10.0.0."), key % 256).alias("src_ip"), key.cast("string").alias("extra"),
    ).write.csv(folder, header=True, quote='"', escape='"')
    events = parse_csv(read_csv(spark, folder))
    return events.select("message", "user", "ip", "raw")


def windows_parse(spark, sf):
    got = parse_windows_xml(adapter.windows_documents(adapter.base(spark, sf)))
    return _event_view(got).drop("pid")


def reclassified(spark, sf):
    """Chat texts as JSON logs, run through the message rules."""
    lines = adapter.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.to_json(F.struct(
            F.concat(F.lit("Accepted password for "), F.col("role"), F.lit(" from 10.1.1.1: "),
                     F.col("text")).alias("message"),
            F.col("role").alias("user"), F.lit("INFO").alias("level"),
        )).alias("value"),
    )
    return reclassify(parse_json_lines(lines)).groupBy(
        "event_type", "severity", "user", "ip"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"))


# ------------------------------------------------------------------ filters
def filter_severity(spark, sf):
    return _event_view(filter_events(adapter.log_events(spark, sf), severity="warning"))


def filter_keyword(spark, sf):
    return _event_view(filter_events(adapter.log_events(spark, sf), keyword="INVALID USER"))


def filter_type(spark, sf):
    return _event_view(filter_events(adapter.log_events(spark, sf), event_type="AUTH_SUCCESS"))


def filter_limit(spark, sf):
    return _event_view(filter_events(
        adapter.log_events(spark, sf), severity="error", keyword="u7 ", event_type="auth_failure",
        limit=25,
    ))


def event_export(spark, sf):
    return _micros(event_columns(adapter.log_events(spark, sf)), "ts")


# ---------------------------------------------------------------- detectors
def peak_count(spark, sf):
    rows = adapter.log_events(spark, sf).filter("event_type = 'auth_failure'")
    return peak_window(
        rows.select("ip", micros(F.col("ts")).alias("t")), "ip", "t", 6 * 3600 * 10**6, 60 * 10**6
    )


def peak_distinct(spark, sf):
    rows = adapter.log_events(spark, sf).filter("event_type = 'auth_failure'")
    return peak_window(
        rows.select("ip", "user", micros(F.col("ts")).alias("t")), "ip", "t", 6 * 3600 * 10**6,
        60 * 10**6, distinct="user",
    )


def brute_force_query(spark, sf, params=WIDE):
    found = brute_force(adapter.stored_events(spark, sf), params)
    started = F.unix_micros(F.col("metadata")["burst_start"].cast("timestamp"))
    return _finding_view(
        found.findings, _meta("total"), _meta("burst_count"), started.alias("burst_start"),
    )


def brute_force_evidence(spark, sf):
    found = brute_force(adapter.stored_events(spark, sf), WIDE)
    return found.evidence.select("finding_id", "event_id", micros(F.col("ts")).alias("ts"), "user")


def password_spray_query(spark, sf):
    found = password_spray(adapter.stored_events(spark, sf), WIDE)
    return _finding_view(found.findings, _meta("distinct_users"), _meta("total_attempts"))


def password_spray_partial(spark, sf):
    found = password_spray(
        adapter.stored_events(spark, sf), Params(spray_window_sec=6 * 3600)
    )
    return _finding_view(found.findings, _meta("distinct_users"), _meta("total_attempts"))


def password_spray_evidence(spark, sf):
    found = password_spray(adapter.stored_events(spark, sf), WIDE)
    return found.evidence.select("finding_id", "event_id", micros(F.col("ts")).alias("ts"), "user")


def enumeration_query(spark, sf):
    found = enumeration(adapter.stored_events(spark, sf), WIDE)
    return _finding_view(found.findings, _meta("distinct_invalid"))


def priv_esc_query(spark, sf):
    return _finding_view(priv_esc(adapter.stored_events(spark, sf)).findings)


def priv_esc_per_host(spark, sf):
    return _finding_view(
        priv_esc(adapter.stored_events(spark, sf), Params(priv_esc_per=("host",))).findings
    )


def priv_esc_evidence(spark, sf):
    found = priv_esc(adapter.stored_events(spark, sf))
    return found.evidence.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"),
        F.count_distinct("user").alias("users"),
    )


def auth_success_query(spark, sf):
    return _finding_view(auth_success(adapter.log_events(spark, sf)).findings)


def detect_all(spark, sf):
    found = detect(adapter.stored_events(spark, sf), WIDE)
    return found.findings.groupBy("rule_id", "severity", "confidence").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("event_count").alias("events")
    )


def detect_one_rule(spark, sf):
    return _finding_view(
        detect(adapter.stored_events(spark, sf), WIDE, rules=["enumeration"]).findings
    )


# ------------------------------------------------------ allowlist, enrichment
def allowlist_events(spark, sf):
    """Findings of all detectors with listed addresses and users left out."""
    found = detect(adapter.stored_events(spark, sf), ALLOWED)
    return found.findings.select("finding_id", "rule_id", "severity", "event_count", "n_users")


def _splits(spark, sf, allowed):
    found = detect(adapter.stored_events(spark, sf), WIDE)
    return split_allowlist(found.findings, found.evidence, allowed)


def _split_view(kept, suppressed):
    return kept.withColumn("reason", F.lit("kept")).unionByName(suppressed).select(
        "finding_id", "reason"
    )


def allowlist_findings(spark, sf):
    return _split_view(*_splits(spark, sf, ALLOWED))


def allowlist_table(spark, sf):
    """Allowlists as tables: the addresses and users of nations and suppliers."""
    ips = adapter.table(spark, sf, "nation").select(
        F.concat_ws(".", F.lit("10.0"), F.col("n_nationkey") % 4, F.col("n_nationkey")).alias("ip")
    )
    users = adapter.table(spark, sf, "supplier").select(
        F.concat(F.lit("u"), F.col("s_suppkey") % 11).alias("user")
    )
    allowed = Params(allowed_ips=ips, allowed_users=users)
    kept, suppressed = _splits(spark, sf, allowed)
    return _split_view(kept, suppressed.withColumn("reason", F.substring_index("reason", ":", 1)))


def geo_enrich(spark, sf):
    table = adapter.ranges(spark, sf)
    got = enrich_geo(adapter.log_events(spark, sf), table, table)
    return got.select(
        "event_id", "ip", *[F.col("geoip")[c].alias(c) for c in (
            "country", "country_name", "city", "latitude", "longitude", "asn", "asn_org")],
    )


def own_detector(spark, sf):
    """A detector a user states, beside a built-in one: logins of one account."""
    def first_account(events, params):
        return auth_success(events.filter(F.col("user") == "u1"), params)

    found = detect(
        adapter.stored_events(spark, sf), WIDE, rules=["enumeration", "first_account"],
        detectors={"first_account": first_account},
    )
    return _finding_view(found.findings)


def own_enricher(spark, sf):
    """Two enrichers one after another, the second reading what the first gave."""
    table = adapter.ranges(spark, sf)
    got = enrich(
        adapter.log_events(spark, sf), lambda e: enrich_geo(e, table, None),
        lambda e: e.withColumn("place", F.concat_ws("/", "geoip.country", "host")),
    )
    return got.groupBy("place").agg(
        F.count(F.lit(1)).alias("events"), F.count("geoip").alias("with_address"))


def correlation_off(spark, sf):
    """Without correlate there are no chains among the findings of a case."""
    return _case(spark, sf)[0].groupBy("rule_id", "is_correlated").agg(F.count(F.lit(1)).alias("findings"))


def report_written(spark, sf):
    """The tables of a written report, read again: rows of each, and of the members the kinds."""
    folder = f"{shared_folder(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    report.write_report(*_case(spark, sf), folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    rows = [
        read(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("row_count"))
        for n in ("findings", "evidence", "timeline", "actions", "export")
    ]
    rows.append(read("members").groupBy(F.concat(F.lit("members "), "kind").alias("name")).agg(
        F.count(F.lit(1)).alias("row_count")))
    return reduce(DataFrame.unionByName, rows)


# -------------------------------------------------------------- correlation
def _found(spark, sf, per_user=False) -> Detection:
    params = DAILY if not per_user else Params(
        brute_force_window_sec=DAY, spray_window_sec=DAY, spray_threshold=12,
        priv_esc_per=("user",),
    )
    return detect(adapter.stored_events(spark, sf, daily=True), params)


def _chains(got) -> DataFrame:
    return _micros(got.findings.filter("is_correlated"), "first_seen", "last_seen").select(
        "finding_id", "rule_id", "severity", F.col("metadata")["triggered_by"].alias("triggered_by"),
        F.array_join("correlated_rules", ",").alias("correlated_rules"),
        "first_seen", "last_seen", "event_count", "n_source_ips", "n_users",
        F.array_join("source_ips", ",").alias("source_ips"),
        F.array_join("users", ",").alias("users"),
    )


def correlate_reference(spark, sf):
    return _chains(correlate(_found(spark, sf), DAILY))


def correlate_evidence(spark, sf):
    got = correlate(_found(spark, sf), DAILY)
    chains = got.findings.filter("is_correlated").select("finding_id")
    return got.evidence.join(chains, "finding_id", "left_semi").groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum")
    )


def correlate_own_rules(spark, sf):
    """Rules a user states: a condition on columns, and a step used twice."""
    rules = (
        SequenceRule("grave_then_login", "Grave finding, then login",
                     (F.col("severity").isin("CRITICAL", "HIGH") & (F.col("rule_id") != "priv_esc"),
                      ("auth_success",)), 3600, "HIGH", "MEDIUM"),
        SequenceRule("three_logins", "Three logins", (("auth_success",),) * 3, 3600, "LOW", "LOW"),
    )
    return _chains(correlate(_found(spark, sf), Params(correlation_window_sec=1800), rules)).drop(
        "source_ips", "users"
    )


def correlate_keyed(spark, sf):
    rules = tuple(
        SequenceRule(**{**r.__dict__, "window_sec": 4 * r.window_sec}) for r in BUILT_IN_RULES
    )
    return _chains(correlate(_found(spark, sf, True), DAILY, rules, mode="keyed"))


# ------------------------------------------------------------------- report
def _case(spark, sf) -> tuple[DataFrame, DataFrame]:
    found = detect(adapter.stored_events(spark, sf), WIDE)
    return stored(found.findings), found.evidence


def severity_filter(spark, sf):
    return at_least(_case(spark, sf)[0], "medium").select("finding_id", "severity")


def info_hidden(spark, sf):
    return without_info(_case(spark, sf)[0]).select("finding_id", "severity")


def findings_flat(spark, sf):
    return _micros(flat_findings(_case(spark, sf)[0]), "first_seen", "last_seen")


def findings_listing(spark, sf):
    return report.listing(_case(spark, sf)[0])


def report_summary(spark, sf):
    return report.summary(*_case(spark, sf))


def report_names(spark, sf):
    return report.names(*_case(spark, sf))


def report_timeline(spark, sf):
    return _micros(report.timeline(*_case(spark, sf)), "ts")


def report_actions(spark, sf):
    return report.actions(_case(spark, sf)[0])


def report_evidence_summary(spark, sf):
    return report.evidence_summary(*_case(spark, sf))


def report_evidence_lines(spark, sf):
    return report.evidence_lines(*_case(spark, sf))


def report_capped_evidence(spark, sf):
    return report.capped_evidence(_case(spark, sf)[1], 10).select("finding_id", "ord", "event_id")


def report_export(spark, sf):
    rows = report.export_rows(*_case(spark, sf))
    return rows.select(
        "finding_id", "first_seen", "event_count", "is_correlated",
        F.size("evidence").cast("bigint").alias("evidence_rows"),
        F.get("evidence", F.lit(0))["message"].alias("first_message"),
    )


# ---------------------------------------------------------------- streaming
def _stream_lines(spark, sf) -> DataFrame:
    """The events table as a stream, rendered as log lines."""
    rows = spark.readStream.schema(adapter.table(spark, sf, "events").schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf)
    return adapter.syslog_lines(adapter.with_actors(rows))


def _stream_events(spark, sf) -> DataFrame:
    return parse_syslog(_stream_lines(spark, sf), adapter.YEAR)


def _drained(spark, stream) -> DataFrame:
    return jobs.drain(stream, f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")


def stream_parse(spark, sf):
    return _event_view(_drained(spark, _stream_events(spark, sf)))


def stream_logins(spark, sf):
    got = _drained(spark, jobs.login_findings(_stream_events(spark, sf), ALLOWED))
    return got.select("finding_id", "title", "severity")


def stream_untimed(spark, sf):
    _, untimed = jobs.split_timed(_stream_events(spark, sf))
    return _event_view(_drained(spark, untimed))


def _timed(spark, sf):
    return jobs.split_timed(_stream_events(spark, sf))[0]


def stream_brute_force(spark, sf):
    """Candidate stretches from the stream, confirmed against stored events."""
    params = Params(brute_force_window_sec=6 * 3600)
    found = _drained(spark, jobs.brute_force_candidates(_timed(spark, sf), params, "1 hour", 7200))
    got = jobs.confirm(found, adapter.stored_events(spark, sf), params)
    return _micros(got, "window_start", "peak_start")


def stream_candidates(spark, sf):
    params = Params(spray_window_sec=6 * 3600, spray_threshold=10)
    found = _drained(
        spark, jobs.password_spray_candidates(_timed(spark, sf), params, "1 hour", 7200)
    )
    return _micros(found, "window_start", "window_end", "last_seen")


def stream_enumeration(spark, sf):
    params = Params(brute_force_window_sec=DAY)
    found = _drained(
        spark, jobs.enumeration_candidates(_timed(spark, sf), params, "1 hour", 6 * 3600)
    )
    return _micros(found, "window_start", "window_end", "last_seen")


def stream_failed_sudo(spark, sf):
    got = _drained(spark, jobs.failed_sudo_counts(
        _timed(spark, sf), Params(failed_sudo_threshold=2, allowed_users=("u2",)), DAY, "1 hour"))
    return _micros(got, "window_start")


def stream_followed_by_login(spark, sf):
    """Addresses with failed logins in an hour, then a login soon after."""
    stream = _timed(spark, sf)
    logins = stream.filter("event_type = 'auth_success'")
    attacks = stream.filter("event_type = 'auth_failure'").select(
        "ip", F.date_trunc("hour", "ts").alias("first_seen")
    )
    got = _drained(spark, jobs.followed_by_login(attacks, logins, 3600, "40 days"))
    return got.select("rule_id", "ip").distinct()


def _run_parts(spark, stream, events: DataFrame, part: Column, parts: int) -> None:
    """Events as a stream of files, a batch per part.  The files of a part are written and taken in
    together, so no part is the work of one task."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for n in range(parts):
        events.filter(part == n).write.parquet(f"{folder}/{n}")
        stream.run(spark.readStream.schema(events.schema).parquet(f"{folder}/*"))


def _detection(spark, sf, params, rules=BUILT_IN_RULES, daily=False) -> StreamDetection:
    """Detection over all events in three batches, in no order of time."""
    stream = StreamDetection(
        spark, f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", params, rules)
    events = adapter.stored_events(spark, sf, daily)
    _run_parts(spark, stream, events, F.col("event_id") % 3, 3)
    return stream


def stream_findings(spark, sf):
    """Whole findings of a stream, of all detectors."""
    return _finding_view(_detection(spark, sf, ALLOWED, ()).detections().findings)


def stream_evidence(spark, sf):
    """What the findings of a stream rest on."""
    return _detection(spark, sf, ALLOWED, ()).detections().evidence.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"))


def stream_chains(spark, sf):
    """Chains of all five rules, found batch by batch."""
    rules = tuple(
        SequenceRule(**{**r.__dict__, "window_sec": 4 * r.window_sec}) for r in BUILT_IN_RULES
    )
    params = Params(
        brute_force_window_sec=DAY, spray_window_sec=DAY, spray_threshold=12, priv_esc_per=("user",))
    return _chains(_detection(spark, sf, params, rules, daily=True).correlation())


def stream_late(spark, sf):
    """Every event of a stream once: in time, late for windows of an hour, or without a time."""
    events = adapter.stored_events(spark, sf)
    kept = Arrivals(spark, f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", events.schema, 5 * DAY, 3600)
    # most events come in order of time, some with the last file
    part = F.when(F.col("event_id") % 5 == 0, 3).otherwise(F.floor(F.dayofmonth("ts") / 11))
    _run_parts(spark, kept, events, F.coalesce(part, F.lit(1)), 4)
    return kept.rows().select("event_id", "batch", "arrival")


def geo_prefixes(spark, sf):
    """Addresses of both kinds in nested prefixes, of which the longest counts."""
    base, n = adapter.table(spark, sf, "events"), F.col("n_nationkey")
    net, host = F.col("user_id") % 4, F.col("user_id") % 20
    six = F.concat(F.lit("2001:db8:"), net, F.lit(":"), F.lower(F.hex(host)), F.lit("::7"))
    events = base.select("event_id", F.when(F.col("event_id") % 2 == 0, six).otherwise(
        F.concat_ws(".", F.lit("10.0"), net, host)).alias("ip"))
    wide, narrow = n < 4, (n >= 4) & (n < 20)
    prefixes = adapter.table(spark, sf, "nation").select("n_name", F.explode(F.array(
        F.when(wide, F.concat(F.lit("2001:db8:"), n, F.lit("::/48"))).when(
            narrow, F.concat(F.lit("2001:db8:"), n % 4, F.lit(":"), F.lower(F.hex(n)), F.lit("::/64"))),
        F.when(wide, F.concat(F.lit("10.0."), n, F.lit(".0/24"))).when(
            narrow, F.concat(F.lit("10.0."), n % 4, F.lit("."), n, F.lit("/32"))))).alias("prefix")).select(
        "prefix", F.lit(0).alias("asn"), F.col("n_name").alias("asn_org"))
    return enrich_prefixes(events, asn=prefixes).select("event_id", "ip", F.col("geoip.asn_org").alias("name"))


QUERIES: dict[str, Query] = {
    "syslog_parse": syslog_parse, "syslog_parse_text": syslog_parse_text,
    "cef_parse": cef_parse, "leef_parse": leef_parse, "json_parse": json_parse,
    "json_document_parse": json_document_parse, "csv_parse": csv_parse,
    "files_load": files_load, "files_ids": files_ids, "files_csv": files_csv,
    "windows_parse": windows_parse, "reclassified": reclassified,
    "filter_severity": filter_severity, "filter_keyword": filter_keyword,
    "filter_type": filter_type, "filter_limit": filter_limit, "event_export": event_export,
    "peak_count": peak_count, "peak_distinct": peak_distinct,
    "brute_force": brute_force_query, "brute_force_evidence": brute_force_evidence,
    "password_spray": password_spray_query, "password_spray_partial": password_spray_partial,
    "password_spray_evidence": password_spray_evidence, "enumeration": enumeration_query,
    "priv_esc": priv_esc_query, "priv_esc_per_host": priv_esc_per_host,
    "priv_esc_evidence": priv_esc_evidence, "auth_success": auth_success_query,
    "detect_all": detect_all, "detect_one_rule": detect_one_rule,
    "allowlist_events": allowlist_events, "allowlist_findings": allowlist_findings,
    "allowlist_table": allowlist_table, "geo_enrich": geo_enrich, "geo_prefixes": geo_prefixes,
    "own_detector": own_detector, "own_enricher": own_enricher,
    "correlation_off": correlation_off, "report_written": report_written,
    "correlate_reference": correlate_reference, "correlate_evidence": correlate_evidence,
    "correlate_own_rules": correlate_own_rules, "correlate_keyed": correlate_keyed,
    "severity_filter": severity_filter, "info_hidden": info_hidden,
    "findings_flat": findings_flat, "findings_listing": findings_listing,
    "report_summary": report_summary, "report_names": report_names,
    "report_timeline": report_timeline, "report_actions": report_actions,
    "report_evidence_summary": report_evidence_summary,
    "report_evidence_lines": report_evidence_lines,
    "report_capped_evidence": report_capped_evidence, "report_export": report_export,
    "stream_parse": stream_parse, "stream_logins": stream_logins,
    "stream_untimed": stream_untimed, "stream_brute_force": stream_brute_force,
    "stream_candidates": stream_candidates, "stream_enumeration": stream_enumeration,
    "stream_failed_sudo": stream_failed_sudo,
    "stream_followed_by_login": stream_followed_by_login,
    "stream_findings": stream_findings, "stream_evidence": stream_evidence,
    "stream_chains": stream_chains, "stream_late": stream_late,
}
