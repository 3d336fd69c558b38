"""Detectors that look at failed logins of one source address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import contains_any, fill, is_filled, listing
from palisade.operators.allow import drop_listed
from palisade.operators.detection import RANKS, Detection, detection, metadata
from palisade.operators.summary import summarise
from palisade.operators.windows import peak_window
from palisade.params import Params
from palisade.plans.storage import stored
from palisade.schema import micros

SECOND = 1_000_000


def _failures(events: DataFrame, params: Params, *more: Column) -> DataFrame:
    """Failed logins with an address that is not on the allowlist."""
    df = events.filter((F.col("event_type") == "auth_failure") & is_filled(F.col("ip")))
    for condition in more:
        df = df.filter(condition)
    return drop_listed(df, "ip", params.allowed_ips)


def source_failures(events: DataFrame, params: Params) -> DataFrame:
    """What the detectors of this module look at."""
    return _failures(events, params)


def _timed(events: DataFrame) -> DataFrame:
    return events.select("ip", "user", micros(F.col("ts")).alias("t"))


def _texts(texts: dict, **columns: Column) -> dict[str, Column]:
    return {k: fill(texts[k], **columns) for k in ("title", "description", "recommendation")}


def brute_force(events: DataFrame, params: Params = Params()) -> Detection:
    """Addresses with at least `brute_force_threshold` failed logins; severity
    by the peak number inside a sliding window.  Evidence: all failed logins
    of the address."""
    window = params.brute_force_window_sec
    rows = _failures(events, params)
    peaks = peak_window(
        _timed(rows), "ip", "t", window * SECOND, params.slice_sec * SECOND
    )
    findings = brute_force_findings(summarise(rows, ["ip"], params.names_kept), peaks, params)
    # counted again: the facts and peaks of the findings would be worked out for the ids alone
    enough = rows.groupBy("ip").agg(F.count(F.lit(1)).alias("total")).filter(
        F.col("total") >= params.brute_force_threshold)
    evidence = rows.join(enough.select("ip", _brute_force_id().alias("finding_id")), "ip")
    return detection(findings, evidence)


def _brute_force_id() -> Column:
    return F.concat(F.lit("brute_force|"), F.col("ip"))


def brute_force_findings(facts: DataFrame, peaks: DataFrame, params: Params) -> DataFrame:
    """Findings from the facts of addresses and their peaks (`ip, peak, peak_start`)."""
    threshold, window = params.brute_force_threshold, params.brute_force_window_sec
    facts = facts.filter(F.col("event_count") >= threshold)
    # an address whose events all lack a time counts as one burst
    burst = F.coalesce(F.col("peak"), F.col("event_count"))
    found = (
        facts.join(peaks, "ip", "left")
        .withColumn("burst", burst)
        .withColumn("finding_id", _brute_force_id())
    )
    critical, high = burst >= 3 * threshold, burst >= threshold
    started = F.timestamp_micros("peak_start")
    return found.select(
        "*",
        F.lit(RANKS["brute_force"]).alias("finding_rank"),
        F.lit("brute_force").alias("rule_id"),
        F.when(critical, "CRITICAL").when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("confidence"),
        *[c.alias(k) for k, c in _texts(
            fixed.BRUTE_FORCE_TEXT, ip=F.col("ip"), total=F.col("event_count"),
            burst=F.col("burst"), minutes=F.lit(window // 60),
            users=listing(F.col("users"), F.col("n_users"), fixed.BRUTE_USERS_SHOWN),
        ).items()],
        metadata(
            ip=F.col("ip"), total=F.col("event_count"), burst_count=F.col("burst"),
            burst_start=started, window_sec=F.lit(window),
            targeted_users=F.array_join("users", ","),
        ).alias("metadata"),
    )


def least_users(rule_id: str, params: Params) -> int:
    """Different users that a window needs for a finding."""
    if rule_id == "password_spray":
        return max(2, params.spray_threshold // 2)
    return params.enumeration_threshold


def _widest_window(rows: DataFrame, window: int, params: Params, least: int) -> DataFrame:
    """Per address the window with most different users: `ip, distinct, t0`.
    Addresses without any timed event use all their events (t0 is null).
    Stored, as findings and evidence read it: a row per address."""
    peaks = peak_window(
        _timed(rows), "ip", "t", window * SECOND, params.slice_sec * SECOND, distinct="user",
    ).select("ip", F.col("peak").alias("distinct"), F.col("peak_start").alias("t0"))
    untimed = (
        rows.groupBy("ip", "user").agg(F.max("ts").alias("ts"))
        .groupBy("ip").agg(
            F.count_distinct(F.nullif(F.col("user"), F.lit(""))).alias("distinct"), F.max("ts").alias("ts")
        )
        .filter(F.col("ts").isNull())
        .select("ip", "distinct", F.lit(None).cast("bigint").alias("t0"))
    )
    return stored(peaks.unionByName(untimed).filter(F.col("distinct") >= least))


def _inside(rows: DataFrame, peaks: DataFrame, window: int, rule_id: str) -> DataFrame:
    """Events of the chosen window of each address."""
    t = micros(F.col("ts"))
    within = F.when(
        F.col("t0").isNotNull(),
        (t >= F.col("t0")) & (t <= F.col("t0") + window * SECOND),
    ).otherwise(F.lit(True))
    return rows.join(peaks, "ip").filter(within).withColumn(
        "finding_id", F.concat(F.lit(rule_id + "|"), F.col("ip"))
    )


def password_spray(events: DataFrame, params: Params = Params()) -> Detection:
    """Addresses that try many different accounts inside a sliding window.
    Evidence: the events of the best window."""
    window = params.spray_window_sec
    rows = _failures(events, params, is_filled(F.col("user")))
    peaks = _widest_window(rows, window, params, least_users("password_spray", params))
    evidence = _inside(rows, peaks, window, "password_spray")
    facts = summarise(evidence, ["finding_id", "ip"], params.names_kept)
    return detection(password_spray_findings(facts, params), evidence)


def password_spray_findings(facts: DataFrame, params: Params) -> DataFrame:
    """Findings from the facts of the best windows."""
    threshold, window = params.spray_threshold, params.spray_window_sec
    high = F.col("n_users") >= threshold
    level = F.when(high, "HIGH").otherwise("MEDIUM")
    return facts.select(
        "*",
        F.lit(RANKS["password_spray"]).alias("finding_rank"),
        F.lit("password_spray").alias("rule_id"),
        level.alias("severity"), level.alias("confidence"),
        *[c.alias(k) for k, c in _texts(
            fixed.PASSWORD_SPRAY_TEXT, ip=F.col("ip"), distinct=F.col("n_users"),
            attempts=F.col("event_count"), minutes=F.lit(window // 60),
            users=listing(F.col("users"), F.col("n_users"), fixed.SPRAY_USERS_SHOWN),
        ).items()],
        metadata(
            ip=F.col("ip"), distinct_users=F.col("n_users"), total_attempts=F.col("event_count"),
            users=F.array_join("users", ","), window_sec=F.lit(window),
        ).alias("metadata"),
    )


def enumeration(events: DataFrame, params: Params = Params()) -> Detection:
    """Addresses that probe account names which do not exist.  Evidence: the
    events of the best window."""
    window = params.brute_force_window_sec
    rows = _failures(
        events, params, contains_any(F.lower("message"), fixed.INVALID_USER_MARKERS)
    )
    peaks = _widest_window(rows, window, params, least_users("enumeration", params))
    evidence = _inside(rows, peaks, window, "enumeration")
    facts = summarise(evidence, ["finding_id", "ip"], params.names_kept)
    return detection(enumeration_findings(facts, params), evidence)


def enumeration_findings(facts: DataFrame, params: Params) -> DataFrame:
    """Findings from the facts of the best windows."""
    level = F.when(F.col("n_users") >= 2 * params.enumeration_threshold, "HIGH").otherwise("MEDIUM")
    return facts.select(
        "*",
        F.lit(RANKS["enumeration"]).alias("finding_rank"),
        F.lit("enumeration").alias("rule_id"),
        level.alias("severity"), level.alias("confidence"),
        *[c.alias(k) for k, c in _texts(
            fixed.ENUMERATION_TEXT, ip=F.col("ip"), distinct=F.col("n_users"),
            users=listing(F.col("users"), F.col("n_users"), fixed.ENUMERATION_USERS_SHOWN),
        ).items()],
        metadata(
            ip=F.col("ip"), distinct_invalid=F.col("n_users"),
            invalid_users=F.array_join("users", ","),
        ).alias("metadata"),
    )
