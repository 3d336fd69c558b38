"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id, text and source and, if rows repeat these, the number
of the copy.  Copies are numbered by sums over the partitions they stand in, so a row that fills a
third of the table is in no single task.  A source whose target is f times its
size takes floor(f) copies of all its documents and one more of those whose hash
is below the source's threshold.  The threshold is found without sorting: sizes
are summed by source and the leading 12 bits of the hash, the bucket that crosses the
budget is looked up, and only this bucket is summed again by its next 12 bits, until
it holds one hash value.  So the histogram has at most 4096 rows per source
and level, and a hot source is combined on the map side.

Targets: the weights 5, 2, 1 repeat over the sources in code point order, null
last.  A target stops at `cap` times the source's size and the excess is shared
again by weight.  The fixed point is min(cap * size, level * weight), and the level
is the maximum over prefixes of the sources ordered by cap * size / weight of
(all - caps in the prefix) / (weights after it): each such quotient is a lower bound,
and the prefix of the capped sources attains it.

Edge cases: a null text has size 0; null and repeated ids are told apart by text and number of
the copy, which copy has which number is left open; sources without words have target 0 and are not taken; an empty table
gives an empty result; other columns are ignored or kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import BROADCAST_ROWS, WORD, cut, small_side

HASH_BITS = 60
LEVEL_BITS = 12


def identity_of(docs: DataFrame) -> Column:
    """What names a row of docs by its id, text and source."""
    return F.concat_ws(
        "|", F.coalesce(docs["doc_id"].cast("string"), F.lit("")),
        *(F.coalesce(F.md5(docs[c].cast("string")), F.lit("")) for c in ("text", "source")))


def hash_of(identity: Column, copy: Column) -> Column:
    """The first 15 hex digits of the md5 of a row's identity and number of the copy."""
    digits = F.substring(F.md5(F.concat(identity, F.lit("|"), copy.cast("string"))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def hashed(rows: DataFrame, identity: Column) -> DataFrame:
    """rows and their `hash of row`.  Only rows that repeat an identity are written and shuffled: each gets the number of
    such rows in earlier partitions and its number among those of its own."""
    named = rows.withColumn("identity of row", identity)
    repeated = small_side(named.groupBy("identity of row").agg(F.count("*").alias("n"))
                          .where("n > 1").select(F.col("identity of row").alias("repeated")))
    same = F.col("identity of row") == F.col("repeated")
    one = hash_of(F.col("identity of row"), F.lit(0)).alias("hash of row")
    if repeated.isEmpty():
        return named.select(*rows.columns, one)
    # written once, as another plan may put rows in other partitions
    placed = cut(named.join(repeated, same, "left_semi").withColumn("part of row", F.spark_partition_id()))
    inside = Window.partitionBy("identity of row", "part of row").orderBy(F.lit(0))
    before = Window.partitionBy("i").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(  # a row per identity and partition
        placed.groupBy(F.col("identity of row").alias("i"), F.col("part of row").alias("p"))
        .agg(F.count("*").alias("n"))
        .select("i", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    copies = (
        placed.withColumn("place of row", F.row_number().over(inside) - 1)
        .join(parts, (F.col("identity of row") == F.col("i")) & (F.col("part of row") == F.col("p")))
        .select(*rows.columns, hash_of(
            F.col("identity of row"), F.col("before") + F.col("place of row")).alias("hash of row"))
    )
    return named.join(repeated, same, "left_anti").select(*rows.columns, one).unionByName(copies)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size -> also target.  One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(w) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    everything = Window.partitionBy()
    before = (
        Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    level = (F.sum("source_size").over(everything)
             - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / (
        F.sum("weight").over(everything)
        - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(
            (F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def thresholds(narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """narrow: source, size, hash; goal: source, need.  Returns source and the
    threshold below which hashes are taken, so that their sizes sum to the need as
    nearly as whole documents allow."""
    few = goal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    state = goal.select(
        F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("before"),
    )
    settled, shift = [], HASH_BITS
    while shift > 0:
        wider, shift = shift, shift - LEVEL_BITS
        inside = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        state = cut(
            narrow.join(
                F.broadcast(state) if few else state,  # a row per source
                F.col("source").eqNullSafe(F.col("s"))
                & (F.shiftright("hash", wider) == F.col("prefix")))
            .groupBy("s", "need", "before", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("size"), F.min("hash").alias("least"),
                 F.max("hash").alias("most"))
            .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .where((F.col("before") <= F.col("need"))
                   & (F.col("need") < F.col("before") + F.col("size")))
        )
        one = F.col("least") == F.col("most")
        # the last hash value is taken if that comes nearer to the need
        settled.append(state.where(one).select(
            "s", (F.col("least") + ((F.col("need") - F.col("before")) * 2 > F.col("size")).cast("long"))
            .alias("threshold")))
        state = state.where(~one).select("s", "need", F.col("bucket").alias("prefix"), "before")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionAll, settled)


def plan(narrow: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: s, source_size, target, whole copies and threshold."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(
        targets(sizes, weights, cap)
        .withColumn("whole", F.coalesce(
            F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    found = thresholds(narrow, goal)
    return goal.join(found, goal["source"].eqNullSafe(found["s"]), "left").select(
        goal["source"].alias("s"), "source_size", "target", "whole",
        F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash of every row, computed once."""
    rows = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                           identity_of(docs).alias("identity")))
    return cut(hashed(rows, F.col("identity")).select(
        "doc_id", "source", "size", F.col("hash of row").alias("hash")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    narrow = _narrow(docs)
    by_source = small_side(plan(narrow, weights, cap))
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")
    return narrow.join(by_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns
    of docs.  The decision is made row by row; only texts of repeated rows are shuffled."""
    by_source = small_side(plan(_narrow(docs), weights, cap).select(
        F.struct("s", "whole", "threshold").alias("plan of row")))
    rows = hashed(docs, identity_of(docs))
    p = F.col("`plan of row`")
    copies = p["whole"] + (F.col("hash of row") < p["threshold"]).cast("long")
    joined = rows.join(by_source, F.col("source").eqNullSafe(p["s"]))
    repeated = F.explode(F.array_repeat(F.lit(1), copies.cast("int")))
    return joined.select(*docs.columns, repeated.alias("copy of row")).select(*docs.columns)
