"""Linux auth.log / syslog lines -> events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import blank_to_null, computed, rx
from palisade.sources.lines import events_of, stripped


def _literal_of(pattern: str) -> str:
    """Longest plain text that every match of a rule pattern contains, in
    lower case; a cheap test that spares most lines the regular expression."""
    plain = re.sub(r"\(\?:[^()]*\)\??|\([^()]*\)", "\0", pattern)
    plain = re.sub(r"\.\*|\\s\+|\^", "\0", plain)
    return max(plain.split("\0"), key=len).lower()


def _by_rule(process: Column, message: Column, lowered: Column) -> Column:
    """What the first rule that a message meets says about it, as a struct."""
    nothing = F.lit(None).cast("string")

    def says(kind, severity, user, second):
        return F.struct(
            F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"),
            user.alias("user"), second.alias("second"),
        )

    chain = F
    for only, pattern, kind, severity in fixed.SYSLOG_RULES:
        regex = rx(pattern, ignore_case=True)
        meets = F.contains(lowered, F.lit(_literal_of(pattern))) & message.rlike(regex)
        if only is not None:
            meets = (F.lower(process) == only) & meets
        groups = [F.regexp_extract(message, regex, n + 1) if n < re.compile(pattern).groups
                  else nothing for n in range(2)]
        chain = chain.when(meets, says(kind, severity, *groups))
    return chain.otherwise(says("generic", "UNKNOWN", nothing, nothing))


def classified(df: DataFrame) -> DataFrame:
    """Set event_type, severity, user and ip from the columns `process` and
    `message` by the classification rules, first match wins."""
    kept = [c for c in df.columns if c not in ("event_type", "severity", "user", "ip")]
    hit = _by_rule(F.col("process"), F.col("message"), F.col("lowered"))
    # a generator of one row, as in events_of: each rule is stated once
    df = df.select(*kept, F.lower("message").alias("lowered")).select(
        *kept, F.inline(F.array(hit))
    )
    second = F.col("second")
    return df.select(
        *kept, "event_type", "severity", "user",
        F.when(second.rlike(rx(fixed.DOTTED_QUAD)), second).alias("ip"),
    )


def line_time(line: Column, year: Column) -> Column:
    """Time stamp at the start of a line; the format has no year."""
    stamp = F.regexp_replace(F.regexp_extract(line, rx(fixed.SYSLOG_TIME), 1), r"(?U)\s+", " ")
    return F.try_to_timestamp(
        F.concat_ws(" ", year.cast("string"), stamp), F.lit(fixed.SYSLOG_TIME_FORMAT)
    )


def parse_syslog(lines: DataFrame, year: int | None = None) -> DataFrame:
    """One event per non-blank line.  A line without the usual header keeps
    its whole text as the message; `year` defaults to the current one."""
    # one pass of the header pattern: the four fields come back separated by
    # line ends, which a line cannot hold
    fields = F.split(F.col("heading"), "\n", 5)
    year_col = F.year(F.current_date()) if year is None else F.lit(year)
    heading = F.regexp_replace("line", rx(fixed.SYSLOG_HEADER), "\n$1\n$2\n$3\n$4")
    df = computed(stripped(lines), "heading", heading).withColumn(
        "headed", F.startswith(F.col("heading"), F.lit("\n"))
    )
    df = computed(df, "part", F.when(F.col("headed"), fields)).select(
        "event_id", "source", F.col("line").alias("raw"),
        line_time(F.col("line"), year_col).alias("ts"),
        F.when(F.col("headed"), F.col("part")[1]).otherwise("").alias("host"),
        F.when(F.col("headed"), F.col("part")[2]).otherwise("").alias("process"),
        blank_to_null(F.col("part")[3]).alias("pid"),
        F.when(F.col("headed"), F.col("part")[4]).otherwise(F.col("line")).alias("message"),
    )
    df = classified(df)
    return events_of(df, **{c: F.col(c) for c in (
        "event_type", "severity", "ts", "host", "process", "pid", "user", "ip", "message", "raw",
    )})
