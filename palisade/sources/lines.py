"""Raw line tables: the common input of the text parsers.

A line table has a `value` column and, where known, `source` and `event_id`.
A log table that carries its own stable id (an offset, a sequence number)
should pass it as `event_id`; lines of files get one from their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import strip
from palisade.schema import EVENTS, conform
from palisade.sources.places import place_id, placed_lines


def spread(df: DataFrame) -> DataFrame:
    """Rows of few files dealt out to all task slots, so that the work that
    follows is not done by a handful of tasks (a gz file is one task).  With
    at least as many files as slots nothing is shuffled."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= slots else df.repartition(slots)


def read_lines(spark: SparkSession, paths, line_sep: str | None = None, stable_ids: bool = True) -> DataFrame:
    """Text files as a line table.  gz and bz2 are decompressed by the reader;
    bytes that are not UTF-8 are replaced.  The id of a line is made of its file and byte
    offset, so it doesn't depend on splits or on other files; `stable_ids=False` saves a pass
    over the files and numbers the lines by partition."""
    names = [paths] if isinstance(paths, str) else list(paths)
    if stable_ids:
        df = lines_with_ids(placed_lines(spark, paths, line_sep or "\n"), line_sep is None)
    else:
        reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
        df = reader.text(paths).select(
            "value",
            F.col("_metadata.file_path").alias("source"),
            F.monotonically_increasing_id().alias("event_id"),
        )
    # only compressed files cannot be split by the reader itself
    return spread(df) if any(n.lower().endswith((".gz", ".bz2")) for n in names) else df


def lines_with_ids(placed: DataFrame, returns: bool = True) -> DataFrame:
    """value, source, event_id of placed lines; `returns`: a carriage return ends a line, too."""
    if not returns:
        return placed.select("value", "source", place_id(F.col("source"), F.col("offset")).alias("event_id"))
    line = F.rtrim(F.col("value"), F.lit("\r"))
    parts = F.when(F.contains(line, F.lit("\r")), F.split(line, "\r")).otherwise(F.array(line))
    return placed.select("source", "offset", F.posexplode(parts).alias("nr", "value")).select(
        "value", "source", place_id(F.col("source"), F.col("offset") + F.col("nr")).alias("event_id"))


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """One row per file, for formats whose record is the whole file."""
    source = F.col("_metadata.file_path")
    return spark.read.text(paths, wholetext=True).select(
        "value", source.alias("source"), place_id(source, F.lit(0)).alias("event_id"),
    )


def event_id(df: DataFrame, source: Column, text: Column) -> Column:
    """The id the input carries, else the place of the row.  A stream has no
    places: there equal lines of one source share an id, unless the stream
    brings one (such as an offset)."""
    if "event_id" in df.columns:
        return F.col("event_id").cast("bigint")
    if df.isStreaming:
        return F.xxhash64(source, text)
    return F.monotonically_increasing_id()


def stripped(lines: DataFrame) -> DataFrame:
    """Lines without white space at the ends, blank ones dropped, with the
    `source` and `event_id` columns filled in where the input lacks them."""
    source = F.col("source") if "source" in lines.columns else F.lit("")
    return lines.select(
        event_id(lines, source, F.col("value")).alias("event_id"),
        source.alias("source"),
        strip(F.col("value")).alias("line"),
    ).filter(F.col("line") != "")


def events_of(df: DataFrame, **columns: Column) -> DataFrame:
    """Event rows from named columns; text that is missing stays empty.

    The columns are produced by a generator of one row.  A filter on an event
    column is then evaluated on the finished value: the optimiser cannot copy
    the parsing expressions into it, which would parse a line once per mention
    of a column.
    """
    types = {f.name: f.dataType for f in EVENTS.fields}
    columns = {n: c.cast(types[n]).alias(n) for n, c in columns.items()}
    for name in ("host", "process"):
        columns.setdefault(name, F.lit("").alias(name))
    columns.setdefault(
        "metadata", F.create_map().cast(types["metadata"]).alias("metadata")
    )
    df = df.select("event_id", "source", F.inline(F.array(F.struct(*columns.values()))))
    return conform(df, EVENTS)
