"""Allowlists: dropping listed events, and splitting findings into kept and
suppressed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.operators.summary import members
from palisade.params import Params


def _is_table(allowed) -> bool:
    return isinstance(allowed, DataFrame)


def _values(allowed: DataFrame, name: str) -> DataFrame:
    return allowed.select(F.col(allowed.columns[0]).alias(name)).distinct()


def drop_listed(events: DataFrame, column: str, allowed) -> DataFrame:
    """Rows whose value is not on the list; rows without a value stay.  A long
    list given as a DataFrame is anti-joined, a short tuple is a literal set."""
    if _is_table(allowed):
        return events.join(_values(allowed, column), column, "left_anti").select(events.columns)
    if not allowed:
        return events
    return events.filter(F.coalesce(~F.col(column).isin(*allowed), F.lit(True)))


def _outside(findings: DataFrame, evidence: DataFrame, kind: str, allowed) -> Column | DataFrame:
    """Findings of which at least one member is not on the list."""
    listed = _values(allowed, "value") if _is_table(allowed) else None
    rows = members(evidence).filter(F.col("kind") == kind)
    if listed is not None:
        rows = rows.join(listed, "value", "left_anti")
    else:
        rows = rows.filter(~F.col("value").isin(*allowed))
    return rows.select("finding_id").distinct().withColumn(f"{kind}_outside", F.lit(True))


def _all_listed(
    findings: DataFrame, evidence: DataFrame, kind: str, names: str, count: str,
    allowed, kept: int,
) -> DataFrame:
    """Add a flag: the finding has members of this kind and all are listed."""
    flag = f"all_{kind}s_listed"
    if not _is_table(allowed) and not allowed:
        return findings.withColumn(flag, F.lit(False))
    if not _is_table(allowed) and len(set(allowed)) <= kept:
        # a finding with more members than the list is not covered by it, any
        # other one carries all its members in the array
        inside = F.array_except(names, F.array(*[F.lit(v) for v in allowed]))
        return findings.withColumn(
            flag, (F.col(count) > 0) & (F.col(count) <= kept) & (F.size(inside) == 0)
        )
    return findings.join(
        _outside(findings, evidence, kind, allowed), "finding_id", "left"
    ).withColumn(
        flag, (F.col(count) > 0) & F.col(f"{kind}_outside").isNull()
    ).drop(f"{kind}_outside")


def split_allowlist(
    findings: DataFrame, evidence: DataFrame, params: Params = Params(),
) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed).  A finding is suppressed when it has addresses and
    all are listed, else when it has users and all are listed.  The suppressed
    ones carry a `reason`."""
    df = _all_listed(findings, evidence, "ip", "source_ips", "n_source_ips",
                     params.allowed_ips, params.names_kept)
    df = _all_listed(df, evidence, "user", "users", "n_users",
                     params.allowed_users, params.names_kept)

    def reason(text: str, names: str, count: str) -> Column:
        return F.concat(
            F.lit(text + ": "), F.array_join(names, ", "),
            F.when(F.col(count) > F.size(names), F.concat(
                F.lit(" (+"), (F.col(count) - F.size(names)).cast("string"), F.lit(" more)")
            )).otherwise(""),
        )

    df = df.withColumn("reason", F.when(
        F.col("all_ips_listed"), reason(fixed.SUPPRESSION_TEXT["ips"], "source_ips", "n_source_ips")
    ).when(
        F.col("all_users_listed"), reason(fixed.SUPPRESSION_TEXT["users"], "users", "n_users")
    )).select(*findings.columns, "reason")
    return (
        df.filter(F.col("reason").isNull()).drop("reason"),
        df.filter(F.col("reason").isNotNull()),
    )
