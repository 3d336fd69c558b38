"""CSV / TSV tables with a header -> events."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import blank_to_null
from palisade.plans.storage import stored
from palisade.sources.lines import event_id, events_of
from palisade.sources.places import place_id, placed_lines, records

_OWN = ("event_id", "source", "line_number")


def _header(text: str, sep: str) -> list[str]:
    """Column names of a header; a name that is used twice or empty gets its position."""
    names = next(csv.reader([text], delimiter=sep), [])
    lower = [n.lower() for n in names]
    return [f"{n or '_c'}{i}" if not n or lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Header files as a table of strings; quoted fields may hold line ends.  Files are
    split as other text: a record begins where the number of quotation marks before it is even.
    The names are those of the first file by path; every file begins with a header."""
    rows = stored(records(placed_lines(spark, paths)))
    first = rows.filter("number = 0").agg(F.min_by("text", "source")).first()[0]
    names = _header(first or "", sep)
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE"}
    found = rows.filter("number > 0").select(
        F.from_csv("text", _ddl(names), options).alias("row"), "source", "offset", "number")
    return found.select(
        *[F.col("row").getField(n).alias(n) for n in names], "source", place_id(F.col("source"), F.col("offset")).alias("event_id"),
        F.col("number").alias("line_number"))


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


def parse_csv(rows: DataFrame) -> DataFrame:
    """Rows of a headed table -> events, by the known column names.  An empty
    message becomes all values joined by a blank."""
    data = [c for c in rows.columns if c not in _OWN]

    def text(names):
        found = next((n for n in names if n in data), None)
        return F.lit("") if found is None else F.coalesce(F.col(f"`{found}`").cast("string"), F.lit(""))

    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in data]
    source = F.col("source") if "source" in rows.columns else F.lit("")
    # the number of a record in its file, where it is known
    numbered = [F.col("line_number")] if "line_number" in rows.columns else []
    number = [F.lit("line_number"), F.col("line_number").cast("string")] if numbered else []
    df = rows.select(
        *[F.col(f"`{c}`") for c in data],
        event_id(rows, source, F.concat_ws(",", *values)).alias("event_id"),
        source.alias("source"), *numbered,
    )
    return events_of(
        df,
        event_type=F.lit("generic"),
        severity=F.lit("UNKNOWN"),
        host=text(fixed.CSV_HOST_COLUMNS),
        process=text(fixed.CSV_PROCESS_COLUMNS),
        pid=blank_to_null(text(fixed.CSV_PID_COLUMNS)),
        user=blank_to_null(text(fixed.CSV_USER_COLUMNS)),
        ip=blank_to_null(text(fixed.CSV_IP_COLUMNS)),
        message=F.coalesce(
            blank_to_null(text(fixed.CSV_MESSAGE_COLUMNS)), F.concat_ws(" ", *values)
        ),
        raw=F.concat_ws(",", *values),
        metadata=F.create_map(F.lit("columns"), F.lit(",".join(data)), *number),
    )
