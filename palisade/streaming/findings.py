"""Findings and attack chains from a stream of events, batch by batch.

Every batch of events is stored by day and type, and what it adds is stored beside it under the
number of the batch: cells (counts per address and user), peaks, findings, firings of rules.
All of it adds up: the facts of a finding are merged from the cells of all batches, its peak is the
best of all peaks.  So a batch looks again only at the addresses it touches, and of their stored events
only at the stretch of time its own events can change; an address is swept over all its time once,
when it first has enough events for a finding.  Nothing waits for a watermark, so late events and events
without a time count as in batch, and the last windows need no closing.

A batch overwrites what an earlier try of the same batch has left, and nobody reads beyond the
own batch; so a restart writes nothing twice.  The present findings are the latest version of each.

Chains are those of keyed mode.  A batch finds the shared values (addresses, users) that its new or changed
findings can reach, runs the rules over the findings around these values, and stores what fires for each
of them, also that nothing does any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import fixed_values as fixed
from palisade.functions.text import contains_any, is_filled
from palisade.operators.accounts import (
    PRIVILEGE_KEYS, auth_success, first_items, privilege_evidence, privilege_findings, privilege_items,
)
from palisade.operators.correlate import (
    BUILT_IN_RULES, SECOND, Correlation, SequenceRule, finding_pool, keyed_correlation, keyed_firings,
)
from palisade.operators.detection import Detection, detection
from palisade.operators.sources_of_attack import (
    brute_force_findings, enumeration_findings, least_users, password_spray_findings, source_failures,
)
from palisade.operators.summary import (
    cells_of, facts_of, finding_members, listed_members, merged_cells, summarise,
)
from palisade.operators.windows import peak_window
from palisade.params import Params
from palisade.plans.pipeline import allowed_out
from palisade.plans.storage import scratch, stored
from palisade.schema import EVENTS, FINDINGS, conform, micros

SOURCE_RULES = ("brute_force", "password_spray", "enumeration")
TYPES = ("auth_failure", "auth_success", "sudo", "su", "user_created", "group_change")

_HIT = "struct<finding_id string, rule_id string, okey {0}, base array<struct<size bigint, finding_id string>>>"
_OKEY = ("struct<t bigint, untimed boolean, finding_rank int, finding_id string, level int>")
LAYOUTS = {
    "events": T.StructType([*[f for f in EVENTS.fields if f.name != "event_type"],
                            T.StructField("batch", T.LongType()), T.StructField("day", T.DateType()),
                            T.StructField("event_type", T.StringType())]),
    "cells": "rule string, ip string, user string, n long, first timestamp, last timestamp, batch long",
    "peaks": "rule string, ip string, peak long, peak_start long, batch long",
    "windows": "finding_id string, ip string, rule string, t0 long, batch long",
    "privileges": "finding_id string, pattern string, ip string, user string, n long, first timestamp, "
                  "last timestamp, batch long",
    "items": "finding_id string, pattern string, ts timestamp, event_id long, item string, batch long",
    "findings": T.StructType([*FINDINGS.fields, T.StructField("batch", T.LongType())]),
    "firings": f"rule_id string, kind string, shared string, trigger {_OKEY}, "
               f"hits array<{_HIT.format(_OKEY)}>, batch long",
}


def _rules_of_row() -> Column:
    """The source detectors that look at a failed login."""
    return F.array_compact(F.array(
        F.lit("brute_force"), F.when(is_filled(F.col("user")), "password_spray"),
        F.when(contains_any(F.lower("message"), fixed.INVALID_USER_MARKERS), "enumeration"),
    ))


class StreamDetection:
    """Detection over a stream, kept in a shared folder.  `advance` is the foreachBatch function.
    Without rules no chains are sought."""

    def __init__(self, spark: SparkSession, folder: str, params: Params = Params(),
                 rules: Sequence[SequenceRule] = BUILT_IN_RULES):
        self.spark, self.folder, self.params, self.rules = spark, folder.rstrip("/"), params, tuple(rules)
        self.window = {
            "brute_force": params.brute_force_window_sec * SECOND,
            "password_spray": params.spray_window_sec * SECOND,
            "enumeration": params.brute_force_window_sec * SECOND,
        }
        self.least = {"brute_force": params.brute_force_threshold,
                      **{r: least_users(r, params) for r in SOURCE_RULES[1:]}}

    # ------------------------------------------------------------- tables
    def _put(self, name: str, batch: int, rows: DataFrame, by: Sequence[str] = ()) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/batch={batch}")

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(LAYOUTS[name]).parquet(f"{self.folder}/{name}")
        return rows if upto is None else rows.filter(F.col("batch") <= upto)

    def events(self, upto: int | None = None) -> DataFrame:
        return self.table("events", upto)

    def _latest(self, name: str, keys: list[str], upto: int | None = None) -> DataFrame:
        """The latest version of each row."""
        rows = self.table(name, upto)
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")

    # -------------------------------------------------------------- batch
    def advance(self, batch: DataFrame, number: int) -> None:
        """Take in one batch of events."""
        with scratch(self.spark):
            rows = conform(batch, EVENTS).filter(F.col("event_type").isin(*TYPES))
            self._put("events", number, rows.withColumn("day", F.to_date("ts")), ["day", "event_type"])
            own = self.events().filter(F.col("batch") == number)
            found = [*self._sources(own, number), self._privileges(own, number),
                     auth_success(own, self.params).findings]
            self._put("findings", number, reduce(DataFrame.unionByName, found))
            if self.rules:
                self._put("firings", number, self._firings(number))

    def _failures(self, events: DataFrame) -> DataFrame:
        """Failed logins, a row per detector that looks at them."""
        return source_failures(events, self.params).withColumn("rule", F.explode(_rules_of_row()))

    def _by_rule(self, values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("rule")]

    def _near(self, upto: DataFrame, chosen: DataFrame, low: Column, high: Column) -> DataFrame:
        """Failures of the chosen (rule, ip) with a time between low and high (microseconds; null: any).
        Days outside of all of them aren't read."""
        first, last, open_ends = chosen.agg(
            F.min(low), F.max(high), F.count_if(low.isNull() | high.isNull())).first()
        if first is None and not open_ends:
            return self._failures(upto.filter(F.lit(False))).join(chosen, ["rule", "ip"])
        if not open_ends:
            day = [F.to_date(F.timestamp_micros(F.lit(x))) for x in (first, last)]
            upto = upto.filter(F.col("day").between(*day))
        t = micros(F.col("ts"))
        return self._failures(upto).join(chosen, ["rule", "ip"]).filter(
            low.isNull() | high.isNull() | t.between(low, high))

    def _sources(self, own: DataFrame, number: int) -> list[DataFrame]:
        params, keys = self.params, ["rule", "ip"]
        upto = self.events(number).filter("event_type = 'auth_failure'")
        self._put("cells", number, cells_of(self._failures(own), keys))
        cells = self.table("cells", number)
        touched = cells.filter(F.col("batch") == number).groupBy(*keys).agg(
            F.min(micros(F.col("first"))).alias("low"), F.max(micros(F.col("last"))).alias("high"))
        old = F.col("batch") < number
        user = F.nullif(F.col("user"), F.lit(""))
        every = stored(cells.join(touched.select(*keys), keys, "left_semi"))
        sizes = every.groupBy(*keys).agg(
            F.sum("n").alias("total"), F.sum(F.when(old, F.col("n"))).alias("total_before"),
            F.count_distinct(user).alias("users"), F.count_distinct(F.when(old, user)).alias("users_before"),
            F.max("last").alias("last"))
        count = F.col("rule") == "brute_force"
        have = F.when(count, F.col("total")).otherwise(F.col("users"))
        had = F.when(count, F.coalesce("total_before", F.lit(0))).otherwise(F.col("users_before"))
        least, window = self._by_rule(self.least), self._by_rule(self.window)
        new = had < least
        chosen = stored(sizes.filter(have >= least).join(touched, keys).select(
            *keys, "total", "users", "last",
            F.when(~new, F.col("low") - window).alias("low"), F.when(~new, F.col("high") + window).alias("high"),
            new.alias("is_new"),
        ))
        # what the batch changes in known addresses, and all of the new ones
        within = ["rule", "ip", "low", "high"]
        known = chosen.filter(~F.col("is_new") & F.col("low").isNotNull()).select(*within)
        swept = chosen.filter("is_new").select(*within)
        inside = stored(self._near(upto, known, F.col("low"), F.col("high")).unionByName(
            self._near(upto, swept, F.col("low"), F.col("high"))).select(
                "rule", "ip", "user", micros(F.col("ts")).alias("t")))
        self._put("peaks", number, reduce(DataFrame.unionByName, [
            peak_window(inside.filter(F.col("rule") == r), "ip", "t", self.window[r], params.slice_sec * SECOND,
                        distinct=None if r == "brute_force" else "user").select(
                F.lit(r).alias("rule"), "ip", "peak", "peak_start") for r in SOURCE_RULES]))
        best = self.table("peaks", number).join(chosen.select(*keys), keys, "left_semi").groupBy(*keys).agg(
            F.max(F.struct("peak", (-F.col("peak_start")).alias("back"))).alias("best"))
        best = stored(chosen.join(best, keys, "left").select(
            *keys, F.col("best.peak").alias("peak"), (-F.col("best.back")).alias("peak_start"), "users", "last"))
        return [self._brute_force(every, best), *self._widest(upto, best, number)]

    def _brute_force(self, cells: DataFrame, best: DataFrame) -> DataFrame:
        best = best.filter("rule = 'brute_force'")
        cells = cells.filter("rule = 'brute_force'").join(best.select("ip"), "ip", "left_semi")
        facts = facts_of(merged_cells(cells, ["ip"]), ["ip"], self.params.names_kept)
        found = brute_force_findings(facts, best.select("ip", "peak", "peak_start"), self.params)
        return detection(found, found).findings

    def _widest(self, upto: DataFrame, best: DataFrame, number: int) -> list[DataFrame]:
        # an address without any timed event is judged over all its events
        untimed = F.col("last").isNull()
        size = F.when(untimed, F.col("users")).otherwise(F.col("peak"))
        windows = best.filter((F.col("rule") != "brute_force") & (size >= self._by_rule(self.least))).select(
            F.concat_ws("|", "rule", "ip").alias("finding_id"), "ip", "rule",
            F.when(~untimed, F.col("peak_start")).alias("t0"))
        self._put("windows", number, windows)
        windows = self.table("windows", number).filter(F.col("batch") == number).drop("batch")
        evidence = stored(self._in_window(upto, windows))
        out = []
        for rule, build in (("password_spray", password_spray_findings), ("enumeration", enumeration_findings)):
            facts = summarise(evidence.filter(F.col("rule") == rule), ["finding_id", "ip"], self.params.names_kept)
            found = build(facts, self.params)
            out.append(detection(found, found).findings)
        return out

    def _in_window(self, events: DataFrame, windows: DataFrame) -> DataFrame:
        return self._near(events, windows, F.col("t0"), F.col("t0") + self._by_rule(self.window))

    def _privileges(self, own: DataFrame, number: int) -> DataFrame:
        evidence = privilege_evidence(own, self.params)
        self._put("privileges", number, cells_of(evidence, PRIVILEGE_KEYS))
        self._put("items", number, privilege_items(evidence))
        cells = self.table("privileges", number)
        touched = cells.filter(F.col("batch") == number).select("finding_id").distinct()
        merged = merged_cells(cells.join(touched, "finding_id", "left_semi"), PRIVILEGE_KEYS)
        items = self.table("items", number).join(touched, "finding_id", "left_semi")
        found = privilege_findings(
            facts_of(merged, PRIVILEGE_KEYS, self.params.names_kept), first_items(items, self.params.names_kept), self.params)
        return detection(found, found).findings

    # ------------------------------------------------------------- chains
    def _present(self, upto: int | None = None) -> Detection:
        """The latest findings, with their evidence out of the stored events."""
        findings = self._latest("findings", ["finding_id"], upto)
        events = self.events(upto)
        failures = events.filter("event_type = 'auth_failure'")
        known = findings.select("finding_id")
        bursts = source_failures(failures, self.params).withColumn(
            "finding_id", F.concat(F.lit("brute_force|"), F.col("ip"))).join(known, "finding_id", "left_semi")
        windows = self._latest("windows", ["finding_id"], upto)
        rights = privilege_evidence(events, self.params).join(known, "finding_id", "left_semi")
        columns = ["finding_id", *EVENTS.names]
        evidence = reduce(DataFrame.unionByName, [
            bursts.select(columns), self._in_window(failures, windows).select(columns), rights.select(columns),
            auth_success(events, self.params).evidence.select(columns)])
        return allowed_out(detection(findings, evidence), self.params)

    def _firings(self, number: int) -> DataFrame:
        """What fires for the shared values that the findings of a batch can reach."""
        found = self._present(number)
        now = stored(found.findings)
        members = stored(finding_members(now, found.evidence))
        own = self.table("findings", number).filter(F.col("batch") == number).select("finding_id", "first_seen")
        before = self._latest("findings", ["finding_id"], number - 1).join(own.select("finding_id"), "finding_id", "left_semi")
        was = stored(before.select("finding_id", F.col("first_seen").alias("seen_before"), "source_ips", "users"))
        pair = ["finding_id", "kind", "value"]
        old_members = was.select("finding_id", F.inline(F.concat(listed_members("ip", "source_ips"), listed_members("user", "users"))))
        # all values of findings that are new or have another time, else those that came or went
        moved = own.join(was, "finding_id", "left").filter(~F.col("first_seen").eqNullSafe(F.col("seen_before"))
                                                          | F.col("source_ips").isNull()).select("finding_id")
        new_members = members.join(own.select("finding_id"), "finding_id", "left_semi")
        differ = reduce(DataFrame.unionByName, [
            new_members.join(moved, "finding_id", "left_semi"), old_members.join(moved, "finding_id", "left_semi"),
            new_members.join(old_members, pair, "left_anti"), old_members.join(new_members, pair, "left_anti")])
        values = stored(differ.select("kind", "value").distinct())
        further = max((len(r.links) for r in self.rules), default=1) - 1

        def around(values: DataFrame) -> DataFrame:
            return members.join(values, ["kind", "value"], "left_semi").select("finding_id").distinct()

        for _ in range(further):
            values = stored(members.join(around(values), "finding_id", "left_semi").select("kind", "value")
                            .unionByName(values).distinct())
        pool, reach = around(values), values
        for _ in range(further):
            reach = members.join(pool, "finding_id", "left_semi").select("kind", "value").distinct()
            pool = stored(around(reach))
        pool_rows = stored(finding_pool(now.join(pool, "finding_id", "left_semi")).filter(F.col("first_seen").isNotNull()))
        near = stored(members.join(pool, "finding_id", "left_semi"))
        out = []
        for rule in self.rules:
            mine = values.filter(F.col("kind") == rule.links[-1]).select("kind", F.col("value").alias("shared"))
            fired = keyed_firings(pool_rows, near, rule, self.params.slice_sec * SECOND)
            out.append(mine.join(fired.drop("rule_id"), "shared", "left").select(
                F.lit(rule.rule_id).alias("rule_id"), "kind", "shared",
                F.col("trigger").cast(_OKEY).alias("trigger"), F.col("hits").cast(f"array<{_HIT.format(_OKEY)}>").alias("hits")))
        return reduce(DataFrame.unionByName, out)

    # ------------------------------------------------------------ results
    def detections(self) -> Detection:
        """What `detect` gives for all events so far."""
        return self._present()

    def correlation(self, evidence_cap: int | None = None) -> Correlation:
        """What keyed correlation gives for all events so far."""
        found = self._present()
        findings = stored(found.findings)
        firings = self._latest("firings", ["rule_id", "kind", "shared"]).filter(F.col("hits").isNotNull())
        return keyed_correlation(
            found, findings, finding_members(findings, found.evidence), firings, self.params, self.rules, evidence_cap)

    def run(self, events: DataFrame, **trigger) -> None:
        """Take in a stream of events, by default all there is."""
        query = (
            events.writeStream.foreachBatch(self.advance)
            .option("checkpointLocation", f"{self.folder}/state")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()
