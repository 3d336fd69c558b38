"""Column layout of events, findings and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import fixed_values as fixed

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("process", T.StringType()),
    T.StructField("pid", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

FINDINGS = T.StructType([
    T.StructField("finding_id", T.StringType()),
    T.StructField("finding_rank", T.IntegerType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("n_source_ips", T.LongType()),
    T.StructField("n_users", T.LongType()),
    T.StructField("source_ips", T.ArrayType(T.StringType())),
    T.StructField("users", T.ArrayType(T.StringType())),
    T.StructField("is_correlated", T.BooleanType()),
    T.StructField("correlated_rules", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

EVIDENCE = T.StructType([T.StructField("finding_id", T.StringType()), *EVENTS.fields])


def conform(df: DataFrame, layout: T.StructType) -> DataFrame:
    """Select the columns of a layout in order, cast to its types; columns the
    frame lacks become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in layout.fields
    ])


def normalise_events(df: DataFrame) -> DataFrame:
    """Bring a table of ready-made events into the event layout: event types
    are checked, severities upper-cased and unknown ones mapped to UNKNOWN."""
    severity = F.upper(F.col("severity"))
    checked = F.when(
        F.col("event_type").isin(*fixed.EVENT_TYPES), F.col("event_type")
    ).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.col("event_type"))))
    return conform(
        df.withColumn("event_type", checked).withColumn(
            "severity",
            F.when(severity.isin(*fixed.SEVERITIES), severity).otherwise("UNKNOWN"),
        ),
        EVENTS,
    )


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(ts)
