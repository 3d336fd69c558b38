"""URL rules, and a list of URLs behind a blocked Bloom filter.

A rule (action, host, path) fits a host and its subdomains if the URL's path begins with
the rule's; the longest rule that fits decides.  A URL that no rule fits is blocked if its
canonical form is on the list.

The list is summed into blocks of eight 64-bit lanes; a URL belongs to one block and sets
one bit in each lane.  The number of blocks grows with the list up to a fixed bound,
so the filter can be broadcast; a fuller filter lets more pass but never a
wrong answer: what it passes goes to an exact join with the list, the rest is
known not to be listed and isn't shuffled.

Canonical form: host without leading "www." and default port, path without trailing slashes,
query without utm_* and ref parameters; no scheme and no fragment.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule
and is never listed; repeated URLs get a row each; an empty list blocks nothing;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut

Rule = tuple[str, str, str]
LANES = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://, else an empty string."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form that is listed; null if the URL has no host."""
    site = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[a-z]+|ref)=") & (p != ""))
    asked = F.array_join(parts, "&")
    form = F.concat(site, F.regexp_replace(path(url), "/+$", ""),
                    F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(site != "", form)


def rule_for(rules: Sequence[Rule], own_host: Column, own_path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its action."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((own_host == h) | own_host.endswith("." + h)) & own_path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _bits(form: Column) -> list[Column]:
    h = F.xxhash64(form, F.lit("lanes"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int"))
            for i in range(LANES)]


def _block(form: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(form), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, per_block: int = 32, most_blocks: int = 1 << 17) -> tuple[DataFrame, int]:
    """block and lanes l0..l7 of the distinct strings `form`, and the number of
    blocks, which is at most most_blocks (64 bytes each)."""
    count = listed.count()
    blocks = min(most_blocks, max(1, -(-count // per_block)))
    lanes = [F.bit_or(bit).alias(f"l{i}") for i, bit in enumerate(_bits(F.col("form")))]
    return listed.groupBy(_block(F.col("form"), blocks).alias("block")).agg(*lanes), blocks


def verdicts(pages: DataFrame, listed_urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url);
    listed_urls has a column url."""
    listed = cut(listed_urls.select(canonical(F.col("url")).alias("form")).where("form is not null").distinct())
    lanes, blocks = bloom(listed)
    name, action = rule_for(rules, F.col("host"), F.col("path"))
    judged = (
        pages.select("page_id", host(F.coalesce("url", F.lit(""))).alias("host"),
                     path(F.coalesce("url", F.lit(""))).alias("path"), canonical(F.col("url")).alias("form"))
        .select("page_id", "host", "path", name.alias("rule"), action.alias("action"), "form")
    )
    probe = judged.select("*", *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("form")))),
                          _block(F.col("form"), blocks).alias("own"))
    may_be = F.lit(True)
    for i in range(LANES):
        may_be = may_be & (F.col(f"l{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    # at most most_blocks rows of 68 bytes
    passed = (
        probe.join(F.broadcast(lanes), F.col("own") == F.col("block"), "left")
        .select("page_id", "host", "path", "rule", "action", "form",
                (F.col("action").isNull() & F.col("form").isNotNull() & F.coalesce(may_be, F.lit(False)))
                .alias("possible"))
    )
    rest = passed.where("not possible").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    exact = (
        passed.where("possible").join(listed.withColumn("on_list", F.lit(True)), "form", "left")
        .select("page_id", "host", "path", "rule",
                F.when(F.col("on_list"), "block").otherwise("allow").alias("verdict"))
    )
    return rest.unionAll(exact)
