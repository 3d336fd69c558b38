"""Adding country and network of the source address to events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade import fixed_values as fixed
from palisade.functions.text import rx

CITY_COLUMNS = {
    "country": "string", "country_name": "string", "city": "string",
    "latitude": "double", "longitude": "double",
}
ASN_COLUMNS = {"asn": "int", "asn_org": "string"}
BLOCK = 65536

# an enricher keeps the rows and adds columns
Enricher = Callable[[DataFrame], DataFrame]


def ip_number(ip: Column) -> Column:
    """Dotted quad -> number, null for anything else."""
    part = F.split(ip, r"\.")
    numbers = [F.get(part, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = ip.rlike(rx(fixed.DOTTED_QUAD))
    for n in numbers:
        valid = valid & (n <= 255)
    a, b, c, d = numbers
    return F.when(valid, ((a * 256 + b) * 256 + c) * 256 + d)


def locate(addresses: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """For each `number` the row of the range that holds it.  Ranges
    (`start_ip`, `end_ip`, both inclusive) do not overlap, so it can only be
    the last one that starts at or before the number.  Both sides are cut into
    blocks of 65 536 addresses, which bounds what one task can receive of a
    block."""
    start, end = F.col("start_ip").cast("bigint"), F.col("end_ip").cast("bigint")
    cut = ranges.select(
        F.explode(F.sequence(F.floor(start / BLOCK), F.floor(end / BLOCK))).alias("block"),
        start.alias("start_ip"), end.alias("end_ip"), *columns,
    ).select(
        "block", F.greatest("start_ip", F.col("block") * BLOCK).alias("at"),
        F.lit(0).alias("asks"), F.struct("end_ip", *columns).alias("range"),
    )
    asked = addresses.select(
        F.floor(F.col("number") / BLOCK).alias("block"), F.col("number").alias("at"),
        F.lit(1).alias("asks"),
    ).distinct()
    w = W.partitionBy("block").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    found = cut.unionByName(asked, allowMissingColumns=True).select(
        "at", "asks", F.last("range", ignorenulls=True).over(w).alias("range")
    )
    return found.filter((F.col("asks") == 1) & (F.col("range.end_ip") >= F.col("at"))).select(
        F.col("at").alias("number"), *[F.col(f"range.{c}").alias(c) for c in columns]
    )


def enrich_geo(
    events: DataFrame, city: DataFrame | None = None, asn: DataFrame | None = None,
) -> DataFrame:
    """Add a `geoip` struct to events: place fields from the `city` ranges,
    network fields from the `asn` ranges.  It is null without an address, and
    its fields are null where no range holds the address.  Without any ranges
    the events pass through unchanged; rows are never dropped."""
    parts = [(t, c) for t, c in ((city, CITY_COLUMNS), (asn, ASN_COLUMNS)) if t is not None]
    if not parts:
        return events
    addresses = events.filter(F.col("ip").isNotNull()).select("ip").distinct().withColumn(
        "number", ip_number(F.col("ip"))
    )
    known = addresses
    for table, layout in parts:
        hits = locate(addresses.filter(F.col("number").isNotNull()), table, list(layout))
        known = known.join(hits, "number", "left")

    def field(name: str, kind: str, here: bool) -> Column:
        if not here:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(name).cast(kind)
        # a range without a name has an empty one, a miss has none
        return value.alias(name)

    fields = [
        field(n, k, t is not None)
        for t, layout in ((city, CITY_COLUMNS), (asn, ASN_COLUMNS)) for n, k in layout.items()
    ]
    lookup = known.select("ip", F.struct(*fields).alias("geoip"))
    # events without an address aren't joined: they would all meet under one key
    found = events.filter(F.col("ip").isNotNull()).join(lookup, "ip", "left").select(
        *events.columns, "geoip"
    )
    nothing = F.lit(None).cast(found.schema["geoip"].dataType).alias("geoip")
    return found.unionByName(
        events.filter(F.col("ip").isNull()).select(*events.columns, nothing)
    )


def enrich(events: DataFrame, *enrichers: Enricher) -> DataFrame:
    """Apply enrichers one after another."""
    for enricher in enrichers:
        events = enricher(events)
    return events
