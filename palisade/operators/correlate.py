"""Linking findings into attack chains: sequences of findings in time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade import fixed_values as fixed
from palisade.operators.asof import earliest_in_window
from palisade.operators.detection import CORRELATED_RANK, Detection
from palisade.operators.summary import finding_members
from palisade.params import Params
from palisade.plans.storage import stored
from palisade.schema import EVIDENCE, FINDINGS, conform, micros

SECOND = 1_000_000

# a step is a tuple of rule ids, or a condition on the columns of a finding
Step = tuple[str, ...] | Column


@dataclass(frozen=True)
class SequenceRule:
    """A chain of findings.  `links` names, for the keyed mode, what each step
    shares with the one before it: 'ip' or 'user'."""

    rule_id: str
    title: str
    steps: tuple[Step, ...]
    window_sec: int
    severity: str
    confidence: str
    description: str = ""
    recommendation: str = ""
    links: tuple[str, ...] = ()


_LINKS = {
    "full_attack_chain": ("ip", "user"), "brute_then_success": ("ip",),
    "success_then_priv_esc": ("user",), "enum_then_brute": ("ip",), "persistent_recon": ("ip",),
}
BUILT_IN_RULES = tuple(
    SequenceRule(**r, links=_LINKS[r["rule_id"]]) for r in fixed.CORRELATION_RULES
)


@dataclass(frozen=True)
class Correlation:
    """`findings`: the given ones and the chains found.  `links`: which given
    findings each chain rests on, in order.  `evidence`: of all findings."""

    findings: DataFrame
    links: DataFrame
    evidence: DataFrame


# --------------------------------------------------------------- conditions
def _meets(step: Step) -> Column:
    return step if isinstance(step, Column) else F.col("rule_id").isin(*step)


def _may_share(a: Step, b: Step) -> bool:
    """Whether one finding could satisfy both steps."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return bool(set(a) & set(b))
    return True


class _Conditions:
    """The different steps of some rules, and how many candidates each needs:
    a step that shares findings with earlier steps may have to pass over the
    ones they took."""

    def __init__(self, rules: Sequence[SequenceRule]):
        self.steps: list[Step] = []
        self.wanted: dict[int, int] = {}
        self.uses: dict[str, list[tuple[int, int]]] = {}
        for rule in rules:
            used = []
            for i, step in enumerate(rule.steps):
                depth = 1 + sum(_may_share(step, s) for s in rule.steps[:i])
                c = self._number(step)
                self.wanted[c] = max(depth, self.wanted.get(c, 0))
                used.append((c, depth))
            self.uses[rule.rule_id] = used

    def _number(self, step: Step) -> int:
        for c, known in enumerate(self.steps):
            if step is known or (
                isinstance(step, tuple) and isinstance(known, tuple) and set(step) == set(known)
            ):
                return c
        self.steps.append(step)
        return len(self.steps) - 1

    def candidates(self, pool: DataFrame, keys: list[str]) -> DataFrame:
        met = F.array(*[
            F.when(_meets(s), F.lit(c)) for c, s in enumerate(self.steps)
        ])
        return pool.select(
            *keys, "t", "okey", "hit", F.explode(F.array_compact(met)).alias("c")
        )

    def hits(self, rule: SequenceRule) -> Column:
        """One candidate per step, none taken twice; null if a step has none."""
        taken: list[Column] = []
        for c, depth in self.uses[rule.rule_id]:
            choices = []
            for n in range(1, depth + 1):
                choice = F.col(f"c{c}_{n}")
                free = reduce(
                    lambda x, y: x & y,
                    [~choice["finding_id"].eqNullSafe(t["finding_id"]) for t in taken],
                    F.lit(True),
                )
                choices.append(F.when(choice.isNotNull() & free, choice) if taken else choice)
            taken.append(F.coalesce(*choices))
        complete = reduce(lambda x, y: x & y, [t.isNotNull() for t in taken])
        return F.when(complete, F.array(*taken))


# ------------------------------------------------------------------- inputs
def finding_pool(findings: DataFrame) -> DataFrame:
    """Findings with their place in time.  Those without a time come last, at
    the time of the latest one, as they push nothing out of the window."""
    t = micros(F.col("first_seen"))
    latest = findings.agg(F.max(t)).first()[0] or 0
    place = findings.withColumn("t", F.coalesce(t, F.lit(latest).cast("bigint")))
    okey = F.struct(
        "t", F.col("first_seen").isNull().alias("untimed"), "finding_rank", "finding_id",
        F.lit(0).alias("level"),
    )
    size = F.col("n_source_ips") + F.col("n_users")
    base = F.array(F.struct(size.alias("size"), "finding_id"))
    return place.withColumn("okey", okey).withColumn("hit", F.struct(
        "finding_id", "rule_id", "okey", base.alias("base")
    ))


# ------------------------------------------------------------ set identity
def _identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and two sums of hashes that identify a set of members."""
    def total(seed):
        return F.sum(F.xxhash64(F.lit(seed), F.col("value")).cast("decimal(20,0)"))

    return rows.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "ip").alias("n_ips"),
        F.count_if(F.col("kind") == "user").alias("n_names"),
        total(1).alias("sum_1"), total(2).alias("sum_2"),
    )


_PARTS = ("n_ips", "n_names", "sum_1", "sum_2")


def _union_identity(chains: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Add the identity of the union of the members of all findings in `base`.
    The largest finding of a chain is never spelled out: its own identity is
    extended by what the others add to it."""
    sized = chains.withColumn("parts", F.reverse(F.array_sort(F.array_distinct("base"))))
    sized = sized.withColumn("largest", F.col("parts")[0]["finding_id"])
    added = (
        sized.select(
            "chain_id", "largest",
            F.explode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("p"),
        )
        .select("chain_id", "largest", F.col("p.finding_id").alias("finding_id"))
        .join(member_rows, "finding_id")
        .select("chain_id", "largest", "kind", "value").distinct()
    )
    known = member_rows.withColumnRenamed("finding_id", "largest")
    added = added.join(known, ["largest", "kind", "value"], "left_anti")
    extra = _identity(added, ["chain_id"])
    own = _identity(known, ["largest"])
    out = sized.join(own, "largest", "left").join(
        extra.select("chain_id", *[F.col(p).alias(f"{p}_x") for p in _PARTS]), "chain_id", "left"
    )
    zero = F.lit(0)
    return out.select(
        *chains.columns,
        *[(F.coalesce(p, zero) + F.coalesce(f"{p}_x", zero)).alias(p) for p in _PARTS],
    )


# ---------------------------------------------------------------- reference
def _levels(rules: Sequence[SequenceRule]) -> list[list[SequenceRule]]:
    """Rules in rounds: one that reads the chains of another comes later."""
    ids = {r.rule_id: r for r in rules}
    reads = {
        r.rule_id: {i for s in r.steps if isinstance(s, tuple) for i in s if i in ids}
        for r in rules
    }
    done: set[str] = set()
    rounds = []
    while len(done) < len(rules):
        ready = [r for r in rules if r.rule_id not in done and reads[r.rule_id] <= done]
        if not ready:
            raise ValueError("correlation rules read each other in a circle")
        rounds.append(ready)
        done |= {r.rule_id for r in ready}
    return rounds


def _fired(pool: DataFrame, rules: Sequence[SequenceRule], window: int, length: int,
           member_rows: DataFrame) -> DataFrame:
    """Chains of one round: rule number, trigger and hits.  A rule looks at
    the window at each time at which a finding arrives, and fires once per set
    of addresses and users."""
    conditions = _Conditions(rules)
    probes = pool.groupBy("t").agg(F.min("okey").alias("arrival"))
    seen = earliest_in_window(
        conditions.candidates(pool, []), probes, [], conditions.wanted, window, length
    )
    matched = seen.select("arrival", F.inline(F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), conditions.hits(r).alias("hits"))
        for r in rules
    ]))).filter(F.col("hits").isNotNull())
    trigger = F.greatest(F.array_max(F.transform("hits", lambda h: h["okey"])), F.col("arrival"))
    ids = F.transform("hits", lambda h: h["finding_id"])
    chains = (
        matched.withColumn("chain_id", F.concat_ws("|", F.col("rule_id"), ids))
        .groupBy("rule_id", "chain_id")
        .agg(F.min_by("hits", trigger).alias("hits"), F.min(trigger).alias("trigger"))
        .withColumn("base", F.flatten(F.transform("hits", lambda h: h["base"])))
    )
    told = _union_identity(chains, member_rows)
    first = F.struct("trigger", "chain_id", "hits", "base", "n_ips", "n_names")
    # a name counts the same whether it is an address or a user
    same = (F.col("n_ips") + F.col("n_names")).alias("n")
    return told.groupBy("rule_id", same, "sum_1", "sum_2").agg(
        F.min_by(first, F.col("trigger")).alias("first")
    ).select("rule_id", "first.*")


# -------------------------------------------------------------------- keyed
def keyed_firings(pool: DataFrame, member_rows: DataFrame, rule: SequenceRule,
                  length: int) -> DataFrame:
    """`rule_id, shared, trigger, hits` of chains in which each step follows the one before within the window of
    the rule and shares its address or user.  Fires once per value shared by
    the last two steps."""
    window = rule.window_sec * SECOND
    length = max(length, window // 4)
    rows = pool.filter(_meets(rule.steps[0])).select("t", "okey", F.array("hit").alias("hits"))
    for nth, (step, kind) in enumerate(zip(rule.steps[1:], rule.links), 1):
        values = member_rows.filter(F.col("kind") == kind).select("finding_id", "value")
        last = F.element_at("hits", -1)["finding_id"]
        earlier = rows.withColumn("finding_id", last).join(values, "finding_id").select(
            "value", "t", "okey", F.struct("hits", last.alias("finding_id")).alias("hit"),
            F.lit(0).alias("c"),
        )
        later = pool.filter(_meets(step)).join(values, "finding_id").select(
            "value", "t", "okey", F.col("hit").alias("own")
        )
        depth = 1 + any(_may_share(step, s) for s in rule.steps[:nth])
        seen = earliest_in_window(earlier, later, ["value"], {0: depth}, window, length)
        choices = [
            F.when(F.col(f"c0_{n}.finding_id") != F.col("own.finding_id"), F.col(f"c0_{n}"))
            for n in range(1, depth + 1)
        ]
        rows = seen.withColumn("before", F.coalesce(*choices)).filter(
            F.col("before").isNotNull()
        ).select(
            F.col("value").alias("shared"), "t", "okey",
            F.concat("before.hits", F.array("own")).alias("hits"),
        )
    return rows.groupBy("shared").agg(
        F.min_by("hits", "okey").alias("hits"), F.min("okey").alias("trigger")
    ).select(F.lit(rule.rule_id).alias("rule_id"), "shared", "trigger", "hits")


def keyed_chains(firings: DataFrame) -> DataFrame:
    """Chains from firings: one finding may be reached by several shared values."""
    ids = F.transform("hits", lambda h: h["finding_id"])
    chain = firings.withColumn("chain_id", F.concat_ws("|", F.col("rule_id"), ids))
    return chain.groupBy("rule_id", "chain_id").agg(
        F.min("trigger").alias("trigger"), F.min_by("hits", "trigger").alias("hits")
    ).withColumn("base", F.flatten(F.transform("hits", lambda h: h["base"])))


# ------------------------------------------------------------------ results
def _links(fired: DataFrame) -> DataFrame:
    return fired.select(
        F.col("chain_id").alias("finding_id"), "rule_id",
        F.posexplode(F.col("base")).alias("position", "b"),
    ).select(
        "finding_id", "rule_id", (F.col("position") + 1).alias("position"),
        F.col("b.finding_id").alias("member_id"),
    )


def _described(fired: DataFrame, findings: DataFrame, rules: Sequence[SequenceRule],
               kept: int) -> DataFrame:
    """Chains in the layout of findings."""
    facts = findings.select(
        F.col("finding_id").alias("member_id"), "first_seen", "last_seen", "event_count",
        "source_ips", "users",
    )

    def union(names):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))), 1, kept)

    # a chain has a handful of members, each with a bounded list of names
    facts = _links(fired).join(facts, "member_id").groupBy("finding_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("event_count").alias("event_count"),
        union("source_ips").alias("source_ips"), union("users").alias("users"),
    )
    df = fired.withColumnRenamed("chain_id", "finding_id").join(facts, "finding_id")

    def text(field: str) -> Column:
        chain = F
        for r in rules:
            chain = chain.when(F.col("rule_id") == r.rule_id, F.lit(getattr(r, field)))
        return chain.otherwise(F.lit(None))

    position = F.array_position(F.array(*[F.lit(r.rule_id) for r in rules]), F.col("rule_id"))
    rule_ids = F.transform("hits", lambda h: h["rule_id"])
    return conform(df.select(
        "finding_id", "rule_id", "first_seen", "last_seen", "event_count", "source_ips", "users",
        (F.lit(CORRELATED_RANK) + position).alias("finding_rank"),
        *[text(c).alias(c) for c in (
            "title", "severity", "confidence", "description", "recommendation")],
        F.col("n_ips").alias("n_source_ips"), F.col("n_names").alias("n_users"),
        F.lit(True).alias("is_correlated"), rule_ids.alias("correlated_rules"),
        F.create_map(
            F.lit("correlated_rules"), F.array_join(rule_ids, ","),
            F.lit("source_ips"), F.array_join("source_ips", ","),
            F.lit("users"), F.array_join("users", ","),
            F.lit("window_sec"), text("window_sec").cast("string"),
            F.lit("is_correlated"), F.lit("true"),
            F.lit("triggered_by"), F.col("trigger.finding_id"),
        ).alias("metadata"),
    ), FINDINGS)


def chain_evidence(links: DataFrame, evidence: DataFrame,
                   cap: int | None = None) -> DataFrame:
    """Events of the chains: those of their members in order; with a cap the
    first ones of each chain.  The cap is applied to each member before the join,
    which changes nothing (the position leads the order) but bounds the joined rows."""
    if cap is not None:
        first = W.partitionBy("finding_id").orderBy(F.col("ts").asc_nulls_last(), "event_id")
        evidence = evidence.withColumn("nr", F.row_number().over(first)).filter(
            F.col("nr") <= cap).drop("nr")
    rows = links.select(F.col("finding_id").alias("chain_id"), "position", "member_id").join(
        evidence.withColumnRenamed("finding_id", "member_id"), "member_id"
    )
    if cap is not None:
        order = W.partitionBy("chain_id").orderBy(
            "position", F.col("ts").asc_nulls_last(), "event_id"
        )
        rows = rows.withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= cap)
    return conform(rows.withColumnRenamed("chain_id", "finding_id"), EVIDENCE)


def correlate(
    found: Detection, params: Params = Params(),
    rules: Sequence[SequenceRule] = BUILT_IN_RULES, mode: str = "reference",
    evidence_cap: int | None = None,
) -> Correlation:
    """Link findings into chains.

    `reference`: all rules share one window of `correlation_window_sec`.  At
    each arrival a rule takes, step by step, the earliest finding in the window
    that satisfies it, whatever its source; it fires once per set of addresses
    and users.  `keyed`: each rule uses its own window, the steps follow one
    another in time and share an address or user.

    The findings are stored first, as every rule reads them."""
    findings = stored(found.findings)
    pool = finding_pool(findings)
    member_rows = finding_members(findings, found.evidence)
    length = params.slice_sec * SECOND
    parts: list[DataFrame] = []
    if mode == "reference":
        window = params.correlation_window_sec * SECOND
        order = {r.rule_id: i for i, r in enumerate(rules)}
        for nr, level in enumerate(_levels(rules)):
            fired = _fired(pool, level, window, max(length, window // 16), member_rows)
            parts.append(stored(fired))
            if nr + 1 < len(_levels(rules)):
                pool = pool.select("t", "okey", "hit", *findings.columns).unionByName(
                    _as_pool(parts[-1], findings, rules, order, params.names_kept)
                )
    elif mode == "keyed":
        timed = pool.filter(F.col("first_seen").isNotNull())
        firings = reduce(DataFrame.unionByName, [
            keyed_firings(timed, member_rows, r, length) for r in rules
        ])
        return keyed_correlation(found, findings, member_rows, firings, params, rules, evidence_cap)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return _correlation(
        found, findings, reduce(DataFrame.unionByName, parts), params, rules, evidence_cap)


def keyed_correlation(
    found: Detection, findings: DataFrame, member_rows: DataFrame, firings: DataFrame,
    params: Params, rules: Sequence[SequenceRule], evidence_cap: int | None = None,
) -> Correlation:
    """The result of keyed mode from the firings of the rules."""
    told = _union_identity(stored(keyed_chains(firings)), member_rows)
    return _correlation(
        found, findings, stored(told.drop("sum_1", "sum_2")), params, rules, evidence_cap)


def _correlation(
    found: Detection, findings: DataFrame, fired: DataFrame, params: Params,
    rules: Sequence[SequenceRule], evidence_cap: int | None,
) -> Correlation:
    links = _links(fired)
    chains = _described(fired, findings, rules, params.names_kept)
    return Correlation(
        findings.unionByName(chains), links,
        found.evidence.unionByName(chain_evidence(links, found.evidence, evidence_cap)),
    )


def _as_pool(fired: DataFrame, findings: DataFrame, rules, order: dict[str, int],
             kept: int) -> DataFrame:
    """Chains as candidates of later rounds: they stand right behind the
    finding that triggered them."""
    described = _described(fired, findings, rules, kept)
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    t = F.col("trigger")
    okey = F.struct(
        t["t"].alias("t"), t["untimed"].alias("untimed"), t["finding_rank"].alias("finding_rank"),
        t["finding_id"].alias("finding_id"),
        (t["level"] + 1 + F.element_at(place, F.col("rule_id"))).alias("level"),
    )
    rows = fired.select(
        F.col("chain_id").alias("finding_id"), t["t"].alias("t"), okey.alias("okey"),
        F.struct(
            F.col("chain_id").alias("finding_id"), "rule_id", okey.alias("okey"), "base"
        ).alias("hit"),
    )
    return rows.join(described, "finding_id").select("t", "okey", "hit", *findings.columns)
