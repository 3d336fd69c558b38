"""Place and network of addresses by nested prefixes, IPv4 and IPv6 alike.

An address is 128 bits, an IPv4 one those of its mapped form (::ffff:0:0/96).  The longest prefix that
holds it is found by equal keys: for each length that occurs in the table (129 at most) the leading bits of the
address are looked up among the prefixes of that length, and the longest hit counts.  So a join on equal
values does it, nested and overlapping prefixes included, and no range is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import rx, strip
from palisade.operators.enrich import ASN_COLUMNS, CITY_COLUMNS, ip_number

_MAPPED = "0" * 20 + "ffff"
_TAIL = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _v6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, null for anything else."""
    tail = ip_number(F.regexp_extract(ip, rx(_TAIL), 0))
    quad = F.contains(ip, F.lit("."))
    low = F.lpad(F.lower(F.hex(tail)), 8, "0")
    # a dotted tail stands for two groups
    plain = F.when(quad, F.concat(
        F.regexp_replace(ip, rx(_TAIL), ""), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))).otherwise(ip)
    return _let(F.split(plain, "::"), _joined)


def _joined(halves: Column) -> Column:
    def groups(half: Column) -> Column:
        return F.when((half.isNull()) | (half == ""), F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    parts = F.struct(left.alias("left"), right.alias("right"), F.size(halves).alias("halves"))

    def filled(p: Column) -> Column:
        given = F.size(p["left"]) + F.size(p["right"])
        every = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), p["right"])
        return F.when((p["halves"] <= 2) & F.when(p["halves"] == 2, given <= 7).otherwise(given == 8), every)

    def digits(every: Column) -> Column:
        return F.when(F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                      F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return _let(_let(parts, filled), digits)


def address_bits(ip: Column) -> Column:
    """The 128 bits of an address as text of 0 and 1, null for what is none.  A zone (%eth0) is left out."""
    text = F.lower(F.regexp_replace(strip(ip), "%.*$", ""))

    def digits(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(":")), _v6_digits(t)).otherwise(
            _let(ip_number(t), lambda n: F.concat(F.lit(_MAPPED), F.lpad(F.lower(F.hex(n)), 8, "0"))))

    def half(hexed: Column, start: int) -> Column:
        return F.lpad(F.conv(F.substring(hexed, start, 16), 16, 2), 64, "0")

    return _let(_let(text, digits), lambda d: F.concat(half(d, 1), half(d, 17)))


def prefix_key(cidr: Column) -> tuple[Column, Column]:
    """(length, leading bits) of a prefix like 10.0.0.0/8 or 2001:db8::/32; without a length the whole address.
    Null for what is none."""
    parts = F.split(cidr, "/")
    address = F.get(parts, F.lit(0))
    bits, shift = address_bits(address), F.when(F.contains(address, F.lit(":")), 0).otherwise(96)
    length = F.when(F.size(parts) == 1, F.lit(128)).otherwise(F.get(parts, F.lit(1)).try_cast("int") + shift)
    known = F.when((length >= shift) & (length <= 128) & bits.isNotNull(), length)
    return known, F.when(known == 0, F.lit("")).otherwise(F.substring(bits, F.lit(1), known))


def locate_prefixes(addresses: DataFrame, prefixes: DataFrame, columns: list[str]) -> DataFrame:
    """For each different `ip` of addresses that a prefix (`prefix`, columns) holds: ip, columns of the longest one,
    of equal prefixes the least."""
    length, bits = prefix_key(F.col("prefix"))
    table = prefixes.select(length.alias("length"), bits.alias("key"), F.struct(*columns).alias("row")).filter(
        F.col("length").isNotNull()).groupBy("length", "key").agg(F.min("row").alias("row"))
    lengths = [r["length"] for r in table.select("length").distinct().collect()]  # 129 at most
    asked = addresses.select("ip").distinct().withColumn("bits", address_bits(F.col("ip"))).filter(
        F.col("bits").isNotNull())
    probes = asked.select("ip", "bits", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")).alias("length"))
    probes = probes.select("ip", "length", F.substring("bits", F.lit(1), F.col("length")).alias("key"))
    return probes.join(table, ["length", "key"]).groupBy("ip").agg(
        F.max_by("row", "length").alias("row")).select("ip", *[F.col("row")[c].alias(c) for c in columns])


def enrich_prefixes(events: DataFrame, city: DataFrame | None = None, asn: DataFrame | None = None) -> DataFrame:
    """Add the `geoip` struct of `enrich_geo` from prefix tables: fields are null where no prefix holds
    the address, the struct is null without an address; rows are never dropped."""
    if city is None and asn is None:
        return events
    addresses = events.filter(F.col("ip").isNotNull()).select("ip").distinct()
    known = addresses
    for table, layout in ((city, CITY_COLUMNS), (asn, ASN_COLUMNS)):
        if table is not None:
            known = known.join(locate_prefixes(addresses, table, list(layout)), "ip", "left")
    fields = [
        (F.col(n) if table is not None else F.lit(None)).cast(k).alias(n)
        for table, layout in ((city, CITY_COLUMNS), (asn, ASN_COLUMNS)) for n, k in layout.items()
    ]
    lookup = known.select("ip", F.struct(*fields).alias("geoip"))
    found = events.filter(F.col("ip").isNotNull()).join(lookup, "ip", "left").select(*events.columns, "geoip")
    nothing = F.lit(None).cast(found.schema["geoip"].dataType).alias("geoip")
    return found.unionByName(events.filter(F.col("ip").isNull()).select(*events.columns, nothing))
