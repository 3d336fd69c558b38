"""Earliest matching row inside a look-back window, without pairing rows.

For every probe at time t: the first, second, ... candidate of a condition
with a time in [t - window, t].  The n-th candidate in order is the answer for
probes in one range of times, and the ranges of a condition do not overlap.
So the answer is the last range that began at or before the probe, a running
value inside a time slice.  A range is copied to each slice it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.operators.windows import slice_start


def with_lags(
    rows: DataFrame, keys: list[str], order: str, values: list[str], depth: int, length: int,
) -> DataFrame:
    """Add `lag_1` ... `lag_<depth>`: the values (a struct) of the preceding
    rows of the same key.  Needs a time column `t` that the order starts with.

    Inside a time slice the rows are near.  Only the first rows of a slice look
    back beyond it, and there the last rows of earlier slices are enough; so
    no task sorts more than a slice, or a few rows per slice, of a key."""
    sliced = rows.withColumn("slice", slice_start(F.col("t"), length))
    inside = W.partitionBy(*keys, "slice")
    value = F.struct(*values)

    def lags(w):
        return [F.lag(value, n).over(w).alias(f"lag_{n}") for n in range(1, depth + 1)]

    up, down = inside.orderBy(order), inside.orderBy(F.col(order).desc())
    near = sliced.select(
        "*", F.row_number().over(up).alias("from_start"), F.row_number().over(down).alias("to_end"),
        *lags(up),
    )
    edge = near.filter((F.col("from_start") <= depth) | (F.col("to_end") <= depth))
    along = W.partitionBy(*keys).orderBy(order)
    first = edge.select(*rows.columns, "from_start", *lags(along)).filter(
        F.col("from_start") <= depth
    )
    names = [*rows.columns, *[f"lag_{n}" for n in range(1, depth + 1)]]
    return near.filter(F.col("from_start") > depth).select(names).unionByName(first.select(names))


def earliest_in_window(
    candidates: DataFrame, probes: DataFrame, keys: list[str], wanted: dict[int, int],
    window: int, length: int,
) -> DataFrame:
    """`candidates`: keys, `c` (number of a condition), `t`, `okey` (total
    order that starts with t) and `hit` (payload).  `probes`: keys, `t` and
    other columns.  `wanted`: how many candidates to find per condition.
    Gives the probes with a column `c<condition>_<n>` per answer, null where
    there is none."""
    most = max(wanted.values())
    # only the first few candidates of equal time can be answers
    order = W.partitionBy(*keys, "c", "t").orderBy("okey")
    rows = candidates.withColumn("nr", F.row_number().over(order)).filter(
        F.col("nr") <= most
    ).drop("nr")
    rows = with_lags(rows, [*keys, "c"], "okey", ["t"], most, length)

    def time_back(n: int) -> Column:
        return F.col(f"lag_{n}.t") if n else F.col("t")

    def nth(n: int) -> Column:
        return F.struct(
            F.lit(n).alias("n"),
            F.greatest("t", time_back(n) + window + 1).alias("begin"),
            (time_back(n - 1) + window).alias("end"),
        )

    asked = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    ranges = rows.select(
        *keys, "c", "hit", F.inline(F.array(*[nth(n) for n in range(1, most + 1)]))
    ).filter((F.col("begin") <= F.col("end")) & (F.col("n") <= F.try_element_at(asked, F.col("c"))))
    step = F.lit(length).cast("bigint")
    marks = ranges.select(
        *keys, "c", "n", "hit", "begin", "end",
        F.explode(F.sequence(
            slice_start(F.col("begin"), length), slice_start(F.col("end"), length), step
        )).alias("slice"),
    ).select(
        *keys, "slice", F.greatest("begin", "slice").alias("at"), F.lit(0).alias("is_probe"),
        "c", "n", F.struct("end", "hit").alias("mark"),
    )
    asking = probes.select(
        *keys, slice_start(F.col("t"), length).alias("slice"), F.col("t").alias("at"),
        F.lit(1).alias("is_probe"),
        F.struct(*[c for c in probes.columns if c not in keys]).alias("probe"),
    )
    inside = W.partitionBy(*keys, "slice").orderBy("at", "is_probe").rowsBetween(
        W.unboundedPreceding, 0
    )
    names = [(c, n) for c, m in wanted.items() for n in range(1, m + 1)]
    filled = marks.unionByName(asking, allowMissingColumns=True).select(
        *keys, "at", "probe", "is_probe",
        *[F.last(
            F.when((F.col("c") == c) & (F.col("n") == n), F.col("mark")), ignorenulls=True
        ).over(inside).alias(f"c{c}_{n}") for c, n in names],
    ).filter(F.col("is_probe") == 1)
    return filled.select(
        *keys, "probe.*",
        *[F.when(F.col(f"c{c}_{n}.end") >= F.col("at"), F.col(f"c{c}_{n}.hit")).alias(f"c{c}_{n}")
          for c, n in names],
    )
