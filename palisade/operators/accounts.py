"""Detectors that look at accounts: privilege escalation and logins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import contains_any, fill, is_filled, listing, strip
from palisade.operators.allow import drop_listed
from palisade.operators.detection import RANKS, Detection, detection, metadata
from palisade.operators.summary import first_names, summarise
from palisade.params import Params

PATTERNS = (
    "high_risk_sudo", "normal_sudo", "failed_sudo", "su", "user_created", "group_change",
)
PRIVILEGE_KEYS = ["finding_id", "pattern"]


def command_of(message: Column) -> Column:
    """What follows the first `COMMAND=`, empty when there is none."""
    return strip(F.regexp_extract(message, r"(?s)COMMAND=(.*)", 1))


def privilege_pattern(events: DataFrame) -> DataFrame:
    """Add `pattern`, the kind of privilege event, and drop all other rows."""
    kind, message = F.col("event_type"), F.col("message")
    failed = contains_any(F.lower(message), fixed.SUDO_FAILURE_MARKERS)
    risky = contains_any(F.lower(command_of(message)), fixed.HIGH_RISK_COMMANDS)
    pattern = (
        F.when((kind == "sudo") & failed, F.when(is_filled(F.col("user")), "failed_sudo"))
        .when((kind == "sudo") & risky, "high_risk_sudo")
        .when(kind == "sudo", "normal_sudo")
        .when(kind.isin("su", "user_created", "group_change"), kind)
    )
    wanted = events.filter(kind.isin("sudo", "su", "user_created", "group_change"))
    return wanted.withColumn("pattern", pattern).filter(F.col("pattern").isNotNull())


def priv_esc(events: DataFrame, params: Params = Params()) -> Detection:
    """One finding per kind of privilege event over the whole input, and one
    per user with repeated failed sudo.  `priv_esc_per` names event columns to
    split the findings by."""
    evidence = privilege_evidence(events, params)
    ordered = first_items(privilege_items(evidence), params.names_kept)
    findings = privilege_findings(summarise(evidence, PRIVILEGE_KEYS, params.names_kept), ordered, params)
    few = F.col("pattern") == "failed_sudo"
    # counted again, not taken from the findings with all their facts
    enough = evidence.filter(few).groupBy("finding_id").agg(F.count(F.lit(1)).alias("total")).filter(
        F.col("total") >= params.failed_sudo_threshold).select("finding_id")
    evidence = evidence.filter(~few).unionByName(
        evidence.filter(few).join(enough, "finding_id", "left_semi").select(evidence.columns)
    )
    return detection(findings, evidence)


def privilege_evidence(events: DataFrame, params: Params) -> DataFrame:
    """The privilege events with the id of the finding they belong to."""
    rows = privilege_pattern(drop_listed(events, "user", params.allowed_users))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in params.priv_esc_per]
    own_user = F.when(F.col("pattern") == "failed_sudo", F.col("user"))
    return rows.withColumn(
        "finding_id", F.concat_ws("|", F.lit("priv_esc"), F.col("pattern"), own_user, *group)
    )


def privilege_items(evidence: DataFrame) -> DataFrame:
    """Commands and new names, with what orders them in time."""
    return evidence.filter(
        (F.col("pattern") == "high_risk_sudo")
        | ((F.col("pattern") == "user_created") & is_filled(F.col("user")))
    ).select(
        *PRIVILEGE_KEYS, "ts", "event_id",
        F.when(F.col("pattern") == "user_created", F.col("user"))
        .otherwise(command_of(F.col("message"))).alias("item"),
    )


def first_items(listed: DataFrame, kept: int) -> DataFrame:
    """The first items of each finding in order of time, as an array."""
    return first_names(
        listed, PRIVILEGE_KEYS, "item", [F.col("ts").asc_nulls_last(), F.col("event_id")], kept, "items",
    )


def privilege_findings(facts: DataFrame, ordered: DataFrame, params: Params) -> DataFrame:
    """Findings from the facts of each kind and its ordered items."""
    facts = facts.filter(
        (F.col("pattern") != "failed_sudo")
        | (F.col("event_count") >= params.failed_sudo_threshold)
    )
    df = facts.join(ordered, PRIVILEGE_KEYS, "left")

    count, users = F.col("event_count"), listing(
        F.col("users"), F.col("n_users"), params.names_kept)
    root = F.col("has_root")
    values = {
        "users": users, "count": count, "user": F.col("users")[0],
        "commands": listing(F.col("items"), count, fixed.COMMANDS_SHOWN, "; "),
        "names": listing(F.col("items"), F.col("n_named"), params.names_kept),
        "target": F.when(root, "root").otherwise(users),
        "root_note": F.when(root, fixed.SU_TEXT["root_note"]).otherwise(""),
    }
    by_pattern = {
        "high_risk_sudo": (fixed.HIGH_RISK_SUDO_TEXT, "CRITICAL", "HIGH", metadata(
            users=F.array_join("users", ","), commands=F.array_join("items", "; "),
            risk=F.lit("high"))),
        "normal_sudo": (fixed.NORMAL_SUDO_TEXT, "MEDIUM", "MEDIUM", metadata(
            users=F.array_join("users", ","), risk=F.lit("normal"))),
        "failed_sudo": (fixed.FAILED_SUDO_TEXT, "HIGH", "HIGH", metadata(
            user=F.col("users")[0], failed_count=count)),
        "su": (fixed.SU_TEXT, None, "MEDIUM", metadata(
            target_users=F.array_join("users", ","), root_switch=root)),
        "user_created": (fixed.USER_CREATED_TEXT, "HIGH", "HIGH", metadata(
            created_users=F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","))),
        "group_change": (fixed.GROUP_CHANGE_TEXT, "HIGH", "MEDIUM",
                         F.create_map().cast("map<string,string>")),
    }

    def pick(value) -> Column:
        chain = None
        for name, spec in by_pattern.items():
            hit = F.col("pattern") == name
            chain = F.when(hit, value(spec)) if chain is None else chain.when(hit, value(spec))
        return chain

    df = df.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rank = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern"))
    su_severity = F.when(root, "HIGH").otherwise("MEDIUM")
    return df.select(
        "*",
        (F.lit(RANKS["priv_esc"] - 1) + rank).cast("int").alias("finding_rank"),
        F.lit("priv_esc").alias("rule_id"),
        *[pick(lambda s, k=k: fill(s[0][k], **values)).alias(k)
          for k in ("title", "description", "recommendation")],
        pick(lambda s: su_severity if s[1] is None else F.lit(s[1])).alias("severity"),
        pick(lambda s: F.lit(s[2])).alias("confidence"),
        pick(lambda s: s[3]).alias("metadata"),
    )


def auth_success(events: DataFrame, params: Params = Params()) -> Detection:
    """One informational finding per successful login.  No shuffle."""
    rows = events.filter(F.col("event_type") == "auth_success")
    rows = drop_listed(rows, "ip", params.allowed_ips)
    rows = drop_listed(rows, "user", params.allowed_users)
    rows = rows.withColumn(
        "finding_id", F.concat(F.lit("auth_success|"), F.col("event_id").cast("string"))
    )
    user, ip = F.nullif(F.col("user"), F.lit("")), F.nullif(F.col("ip"), F.lit(""))
    shown = {
        "user": F.coalesce(user, F.lit("unknown")), "ip": F.coalesce(ip, F.lit("unknown")),
    }
    findings = rows.select(
        "finding_id",
        F.lit(RANKS["auth_success"]).alias("finding_rank"),
        F.lit("auth_success").alias("rule_id"),
        F.lit("INFO").alias("severity"), F.lit("HIGH").alias("confidence"),
        *[fill(fixed.AUTH_SUCCESS_TEXT[k], **shown).alias(k)
          for k in ("title", "description", "recommendation")],
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
        F.lit(1).alias("event_count"),
        ip.isNotNull().cast("bigint").alias("n_source_ips"),
        user.isNotNull().cast("bigint").alias("n_users"),
        F.array_compact(F.array(ip)).alias("source_ips"),
        F.array_compact(F.array(user)).alias("users"),
        metadata(ip=shown["ip"], user=shown["user"]).alias("metadata"),
    )
    return detection(findings, rows)
