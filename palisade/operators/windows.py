"""Peak sliding windows over event times, exact and split by time.

A key may own most of the rows, so no step sorts all rows of a key in one
task: rows are combined per time value, then handled in time slices of fixed
length, and only one small row per slice is carried along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def slice_start(t: Column, length: int) -> Column:
    """Start of the time slice that holds t (also for negative times)."""
    return t - F.pmod(t, F.lit(length).cast("bigint"))


def with_previous(rows: DataFrame, keys: list[str], t: str, length: int) -> DataFrame:
    """Add `previous`: the preceding time of the same key, null for the first.
    Expects one row per key and time.

    Inside a time slice the preceding row is near.  Only the first row of a
    slice looks beyond it, to the last row of an earlier slice; so no task
    sorts more than a slice, or two rows per slice, of a key."""
    sliced = rows.withColumn("slice", slice_start(F.col(t), length))
    inside, along = W.partitionBy(*keys, "slice").orderBy(t), W.partitionBy(*keys).orderBy(t)
    near = sliced.select(
        "*", F.lag(t).over(inside).alias("previous"), F.lead(t).over(inside).alias("next")
    )
    edge = near.filter(F.col("previous").isNull() | F.col("next").isNull())
    first = edge.select(
        *rows.columns, F.col("previous").isNull().alias("is_first"),
        F.lag(t).over(along).alias("previous"),
    ).filter("is_first")
    names = [*rows.columns, "previous"]
    return near.filter(F.col("previous").isNotNull()).select(names).unionByName(
        first.select(names)
    )


def peak_window(
    events: DataFrame, key: str, t: str, window: int, length: int, distinct: str | None = None,
) -> DataFrame:
    """Busiest closed window [t0, t0 + window] of each key, where t0 is the
    time of one of its events.  Gives `key, peak, peak_start, peak_rows`:
    without `distinct` the peak counts rows, with it different non-empty values
    of that column.  The earliest start wins a tie; `peak_rows` is the row
    count of the chosen window.  Times are whole numbers; rows without a time
    or key are left out.

    An event at t lies in the windows that start in [t - window, t].  Standing
    only for the first occurrence of its value, it counts for starts after the
    previous occurrence.  So the counts are running sums over the ends of these
    ranges.
    """
    events = events.filter(F.col(key).isNotNull() & F.col(t).isNotNull())
    open_at, weight = F.col(t) - window, F.lit(0)
    if distinct is None:
        cells = events.groupBy(key, t).agg(F.count(F.lit(1)).alias("n"))
    else:
        value = F.nullif(F.col(distinct), F.lit(""))
        cells = events.groupBy(key, value.alias("value"), t).agg(F.count(F.lit(1)).alias("n"))
        cells = with_previous(cells, [key, "value"], t, length)
        weight = F.when(F.col("value").isNull(), 0).otherwise(1)
        open_at = F.greatest(open_at, F.col("previous") + 1)

    zero, n = F.lit(0).cast("bigint"), F.col("n").cast("bigint")
    weight = weight.cast("bigint")

    def point(at, values, rows, values_off, rows_off, start):
        return F.struct(
            at.alias("at"), values.alias("values"), rows.alias("rows"),
            values_off.alias("values_off"), rows_off.alias("rows_off"),
            F.lit(start).alias("is_start"),
        )

    # what opens at a time counts there; what closes at a time still does
    ends = [
        point(F.col(t) - window, zero, n, zero, zero, False),
        point(F.col(t), zero, zero, weight, n, True),
    ]
    if distinct is not None:
        ends.append(point(open_at, weight, zero, zero, zero, False))
    points = cells.select(key, F.inline(F.array(*ends))).withColumn(
        "slice", slice_start(F.col("at"), length)
    )
    ordered = W.partitionBy(key, "slice").orderBy("at")
    upto = ordered.rangeBetween(W.unboundedPreceding, 0)
    until = ordered.rangeBetween(W.unboundedPreceding, -1)

    def here(name: str) -> Column:
        return F.sum(name).over(upto) - F.coalesce(F.sum(f"{name}_off").over(until), zero)

    running = points.select(
        key, "slice", "at", "is_start",
        (F.col("values") - F.col("values_off")).alias("values"),
        (F.col("rows") - F.col("rows_off")).alias("rows"),
        here("values").alias("values_here"), here("rows").alias("rows_here"),
    )
    measure = "rows_here" if distinct is None else "values_here"
    slices = running.groupBy(key, "slice").agg(
        F.sum("values").alias("values"), F.sum("rows").alias("rows"),
        F.max(F.when(F.col("is_start"), F.struct(
            F.col(measure).alias("peak"), (-F.col("at")).alias("minus_at"),
            F.col("rows_here").alias("rows"),
        ))).alias("best"),
    )
    # sums up to the start of a slice are the same for all of its points
    earlier = W.partitionBy(key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    rows_before = F.coalesce(F.sum("rows").over(earlier), zero)
    values_before = F.coalesce(F.sum("values").over(earlier), zero)
    best = slices.select(
        key, "best", rows_before.alias("rows_before"),
        (rows_before if distinct is None else values_before).alias("before"),
    ).groupBy(key).agg(
        F.max(F.when(F.col("best").isNotNull(), F.struct(
            (F.col("best.peak") + F.col("before")).alias("peak"), F.col("best.minus_at"),
            (F.col("best.rows") + F.col("rows_before")).alias("rows"),
        ))).alias("best")
    )
    return best.select(
        key, F.col("best.peak").alias("peak"), (-F.col("best.minus_at")).alias("peak_start"),
        F.col("best.rows").alias("peak_rows"),
    )
