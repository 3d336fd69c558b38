"""JSON logs (one object per line, or whole documents) -> events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import blank_to_null, computed, first_key, last_wins_map
from palisade.sources.lines import events_of, stripped


def severity_of(m: Column) -> Column:
    names = F.create_map(*[
        F.lit(x) for pair in fixed.JSON_SEVERITY_MAP.items() for x in pair
    ])
    word = F.lower(first_key(m, fixed.JSON_SEVERITY_KEYS))
    return F.coalesce(F.try_element_at(names, word), F.lit("UNKNOWN"))


def time_of(m: Column) -> Column:
    """Time text in one of the accepted shapes; a trailing Z is not a zone
    here, all times are taken as UTC."""
    text = first_key(m, fixed.JSON_TIME_KEYS)
    iso, plain = fixed.JSON_TIME_SHAPES
    whole = F.regexp_replace(F.regexp_extract(text, r"^[^.Z]*", 0), r"T|\s+", " ")
    fraction = F.regexp_extract(text, r"\.(\d+)", 1)
    seconds = F.try_to_timestamp(whole, F.lit("yyyy-M-d H:m:s"))
    micros = F.unix_micros(seconds) + F.rpad(fraction, 6, "0").try_cast("bigint")
    return F.when(text.rlike(iso) | text.rlike(plain),
                  F.when(fraction != "", F.timestamp_micros(micros)).otherwise(seconds))


def _objects(df: DataFrame) -> DataFrame:
    """Rows whose `raw` text is an object, with its fields as the map `obj`."""
    df = df.filter(F.startswith(F.col("raw"), F.lit("{")))
    df = computed(df, "pairs", F.map_entries(F.from_json("raw", "map<string,string>")))
    return computed(
        df.filter(F.col("pairs").isNotNull()), "obj", last_wins_map(F.col("pairs"))
    ).drop("pairs")


def _events(df: DataFrame) -> DataFrame:
    m = F.col("obj")

    def text(keys):
        return F.coalesce(first_key(m, keys), F.lit(""))

    return events_of(
        df,
        event_type=F.lit("generic"),
        severity=severity_of(m),
        ts=time_of(m),
        host=text(fixed.JSON_HOST_KEYS),
        process=text(fixed.JSON_PROCESS_KEYS),
        pid=blank_to_null(text(fixed.JSON_PID_KEYS)),
        user=blank_to_null(text(fixed.JSON_USER_KEYS)),
        ip=blank_to_null(text(fixed.JSON_IP_KEYS)),
        message=F.coalesce(first_key(m, fixed.JSON_MESSAGE_KEYS), F.col("raw")),
        raw=F.col("raw"),
        metadata=F.create_map(F.lit("line_number"), F.col("line_number").cast("string")),
    )


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """One object per line; lines that are not an object are skipped.  Field
    values keep their JSON text.  `line_no`, if the input has it, is kept as
    the line number."""
    number = "line_no" in lines.columns
    df = stripped(lines) if not number else stripped(
        lines.withColumn("event_id", F.col("line_no"))
    )
    df = _objects(df.select("event_id", "source", F.col("line").alias("raw")))
    return _events(df.select(
        "event_id", "source", "raw", "obj",
        (F.col("event_id") if number else F.lit(None).cast("bigint")).alias("line_number"),
    ))


def parse_json_documents(documents: DataFrame) -> DataFrame:
    """Whole documents holding one array of objects or one object; elements
    that are not objects are skipped."""
    df = stripped(documents)
    single = F.startswith(F.col("line"), F.lit("{"))
    listed = F.from_json(
        F.when(single, F.concat(F.lit("["), F.col("line"), F.lit("]"))).otherwise(F.col("line")),
        "array<string>",
    )
    df = df.select("event_id", "source", F.posexplode(listed).alias("pos", "raw"))
    # an element is told by its document and its place there
    return _events(_objects(df).select(
        F.xxhash64("event_id", "source", "pos").alias("event_id"), "source", "raw", "obj",
        (F.col("pos") + 1).alias("line_number"),
    ))
