"""Facts about findings taken from their evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.functions.text import is_filled


def first_names(
    rows: DataFrame, keys: list[str], value: str, order: list[Column], kept: int, name: str,
) -> DataFrame:
    """The first `kept` values per key in an order, as an array.  The limit is
    applied in each map task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("nr", F.row_number().over(w)).filter(F.col("nr") <= kept)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("nr", F.col(value).alias("value")))).alias("a"))
        .select(*keys, F.col("a.value").alias(name))
    )


def members(evidence: DataFrame, keys: list[str] = ["finding_id"]) -> DataFrame:
    """Every different address and user of each finding: `kind, value`."""
    cells = evidence.select(*keys, "ip", "user").distinct()
    return (
        cells.select(*keys, F.inline(F.array(
            F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("value")),
            F.struct(F.lit("user").alias("kind"), F.col("user").alias("value")),
        )))
        .filter(is_filled(F.col("value"))).distinct()
    )


def listed_members(kind: str, names: str) -> Column:
    """The names in an array as `kind, value`."""
    return F.transform(names, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def finding_members(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id, kind, value of all members of stored findings.  A finding
    row itself holds them unless there are more than it keeps; only for such
    findings the evidence is read."""
    more = (F.col("n_source_ips") > F.size("source_ips")) | (F.col("n_users") > F.size("users"))
    out = findings.filter(~more).select("finding_id", F.inline(F.concat(
        listed_members("ip", "source_ips"), listed_members("user", "users")
    )))
    large = findings.filter(more).select("finding_id")
    if large.isEmpty():
        return out
    return out.unionByName(members(evidence.join(large, "finding_id", "left_semi")))


def cells_of(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, address and user with `n, first, last`: what facts are merged
    from.  Keys that hold the address itself (the per-source detectors) add none."""
    return evidence.groupBy(*keys, *([] if "ip" in keys else ["ip"]), "user").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def merged_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of several parts of the input as those of the whole."""
    return cells.groupBy(*keys, *([] if "ip" in keys else ["ip"]), "user").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
    )


def summarise(evidence: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """Per finding: event_count, first_seen, last_seen, n_source_ips, n_users,
    n_named (events that name a user), has_root, and the first `kept` names of
    the sorted source_ips and users.  Keys that hold the address itself (the
    per-source detectors) need no list of addresses."""
    return facts_of(cells_of(evidence, keys), keys, kept)


def facts_of(cells: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """The facts of `summarise` from cells."""
    user = F.nullif(F.col("user"), F.lit(""))
    ip = F.nullif(F.col("ip"), F.lit(""))
    named = is_filled(F.col("user"))
    facts = cells.groupBy(*keys).agg(
        F.sum("n").alias("event_count"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        # with the address among the keys a user has one cell
        *([F.count_if(named).alias("n_users")] if "ip" in keys else [
            F.count_distinct(user).alias("n_users"),
            F.count_distinct(ip).alias("n_source_ips"),
        ]),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("n_named"),
        F.bool_or(F.coalesce(F.col("user") == "root", F.lit(False))).alias("has_root"),
    )

    def names(column: str, name: str) -> DataFrame:
        values = cells.filter(is_filled(F.col(column)))
        if "ip" not in keys:
            values = values.groupBy(*keys, column).agg(F.lit(1).alias("one"))
        return first_names(values, keys, column, [F.col(column)], kept, name)

    out = facts.join(names("user", "users"), keys, "left")
    if "ip" in keys:
        out = out.withColumn("n_source_ips", F.lit(1).cast("bigint")).withColumn(
            "source_ips", F.array("ip")
        )
    else:
        out = out.join(names("ip", "source_ips"), keys, "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("users", F.coalesce("users", empty)).withColumn(
        "source_ips", F.coalesce("source_ips", empty)
    )
