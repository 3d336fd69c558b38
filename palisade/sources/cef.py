"""CEF and LEEF lines -> events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import (
    computed, contains_any, first_filled_key, first_key, is_filled, last_wins_map, rx, strip,
)
from palisade.sources.lines import events_of, stripped

_MAX_MILLIS = 253402300799999  # end of the year 9999


def severity_of(text: Column) -> Column:
    """Numeric or worded severity -> level."""
    number = F.try_to_number(strip(text), F.lit("S9999999999999999999"))
    level = None
    for low, name in fixed.CEF_SEVERITY_STEPS:
        level = F.when(number >= low, name) if level is None else level.when(number >= low, name)
    word = F.lower(text)
    return (
        F.when(number.isNotNull(), level.otherwise("DEBUG"))
        .when(word.isin(*fixed.CEF_ERROR_WORDS), "ERROR")
        .when(word.isin(*fixed.CEF_WARNING_WORDS), "WARNING")
        .otherwise("UNKNOWN")
    )


def extension_pairs(ext: Column) -> Column:
    """`key=value key=value` text -> pairs.  The text is cut before each key;
    a piece counts when its value holds no bare '=' up to its end."""
    pair = rx(r"(\w+)=([^\\=]*+(?:\\.[^\\=]*+)*+)$")
    pieces = F.split(ext, r"(?U)\s+(?=\w+=)")
    entries = F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, pair, 1).alias("key"),
        strip(
            F.replace(
                F.replace(F.regexp_extract(p, pair, 2), F.lit("\\="), F.lit("=")),
                F.lit("\\n"), F.lit("\n"),
            )
        ).alias("value"),
    ))
    return F.filter(entries, lambda e: e["key"] != "")


def attribute_pairs(text: Column) -> Column:
    """Tab-separated `key=value` text -> pairs."""
    pieces = F.filter(F.split(text, "\t"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(pieces, lambda p: F.struct(
        strip(F.substring_index(p, "=", 1)).alias("key"),
        strip(F.substr(p, F.locate("=", p) + 1)).alias("value"),
    ))


def _event_type(words: Column) -> Column:
    return (
        F.when(contains_any(words, fixed.CEF_FAILURE_WORDS), "auth_failure")
        .when(contains_any(words, fixed.CEF_SUCCESS_WORDS), "auth_success")
        .when(contains_any(words, fixed.CEF_SUDO_WORDS), "sudo")
        .when(contains_any(words, fixed.CEF_CREATED_WORDS), "user_created")
        .otherwise("generic")
    )


def _first_address(m: Column) -> Column:
    quad = rx(fixed.DOTTED_QUAD)
    return F.coalesce(*[
        F.when(v.rlike(quad), v)
        for v in (F.try_element_at(m, F.lit(k)) for k in fixed.CEF_IP_KEYS)
    ])


def _first_millis(m: Column) -> Column:
    values = (
        F.try_element_at(m, F.lit(k)).try_cast("bigint") for k in fixed.CEF_TIME_KEYS
    )
    return F.coalesce(*[
        F.when(F.abs(v) <= _MAX_MILLIS, F.timestamp_millis(v)) for v in values
    ])


def _suffixes(ip: Column, user: Column) -> Column:
    return F.concat(
        F.when(is_filled(ip), F.concat(F.lit(" | src="), ip)).otherwise(""),
        F.when(is_filled(user), F.concat(F.lit(" | user="), user)).otherwise(""),
    )


def _metadata(prefix: str, attributes: Column, **named: Column) -> Column:
    base = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])
    return F.map_concat(
        base, F.transform_keys(attributes, lambda k, _: F.concat(F.lit(prefix + "."), k))
    )


def parse_cef(lines: DataFrame) -> DataFrame:
    """Lines that hold `CEF:`, from that mark on; a header without its seven
    bars drops the line."""
    f = F.col("f")
    df = computed(
        stripped(lines).filter(F.contains("line", F.lit("CEF:"))),
        "f", F.split(F.substr("line", F.locate("CEF:", "line")), r"\|", 8),
    ).filter((F.size("f") == 8) & f[0].rlike(rx(r"^CEF:\d+$")))
    df = (
        computed(computed(df, "pairs", extension_pairs(f[7])), "ext", last_wins_map(F.col("pairs")))
        .withColumn("ip", _first_address(F.col("ext")))
        .withColumn("user", first_filled_key(F.col("ext"), fixed.CEF_USER_KEYS))
    )
    maker = F.concat_ws("/", f[1], f[2])
    return events_of(
        df,
        event_type=_event_type(F.lower(F.concat_ws(" ", f[5], f[4]))),
        severity=severity_of(f[6]),
        ts=_first_millis(F.col("ext")),
        host=F.coalesce(first_key(F.col("ext"), fixed.CEF_HOST_KEYS), F.lit("")),
        process=maker,
        user=F.col("user"),
        ip=F.col("ip"),
        message=F.concat(
            F.lit("[CEF] "), maker, F.lit(" | "), f[5], F.lit(" | SigID="), f[4],
            _suffixes(F.col("ip"), F.col("user")),
        ),
        raw=F.col("line"),
        metadata=_metadata(
            "ext", F.col("ext"), format=F.lit("CEF"), vendor=f[1], product=f[2],
            sig_id=f[4], cef_name=f[5],
        ),
    )


def parse_leef(lines: DataFrame) -> DataFrame:
    """Lines that hold `LEEF:` and no `CEF:`; always of the generic type and
    without a time."""
    f = F.col("f")
    df = computed(
        stripped(lines).filter(
            F.contains("line", F.lit("LEEF:")) & ~F.contains("line", F.lit("CEF:"))
        ),
        "f", F.split(F.substr("line", F.locate("LEEF:", "line")), r"\|", 6),
    ).filter(F.size("f") == 6)
    df = (
        computed(
            computed(df, "pairs", attribute_pairs(f[5])), "attrs", last_wins_map(F.col("pairs"))
        )
        .withColumn("ip", first_key(F.col("attrs"), fixed.LEEF_IP_KEYS))
        .withColumn("user", first_key(F.col("attrs"), fixed.LEEF_USER_KEYS))
    )
    maker = F.concat_ws("/", f[1], f[2])
    level = F.coalesce(
        first_key(F.col("attrs"), fixed.LEEF_SEVERITY_KEYS), F.lit(fixed.LEEF_DEFAULT_SEVERITY)
    )
    return events_of(
        df,
        event_type=F.lit("generic"),
        severity=severity_of(level),
        host=F.coalesce(first_key(F.col("attrs"), ("dst",)), F.lit("")),
        process=maker,
        user=F.col("user"),
        ip=F.col("ip"),
        message=F.concat(
            F.lit("[LEEF] "), maker, F.lit(" | EventID="), f[4],
            _suffixes(F.col("ip"), F.col("user")),
        ),
        raw=F.col("line"),
        metadata=_metadata(
            "attrs", F.col("attrs"), format=F.lit("LEEF"), vendor=f[1], product=f[2],
            event_id=f[4],
        ),
    )


def parse_cef_leef(lines: DataFrame) -> DataFrame:
    """A file that mixes both formats."""
    return parse_cef(lines).unionByName(parse_leef(lines))
