"""Longest prefixes against the ipaddress module."""

import ipaddress
import random

from pyspark.sql import functions as F

from fixtures import event, events_frame
from palisade.operators.prefixes import address_bits, enrich_prefixes, locate_prefixes


def bits_of(text):
    try:
        a = ipaddress.ip_address(text.strip().split("%")[0])
    except ValueError:
        return None
    n = int(a) if a.version == 6 else (0xFFFF << 32) + int(a)
    return f"{n:0128b}"


def test_addresses(spark):
    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:DB8::ff00:42:8329", "fe80::1%eth0",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1::2::3", "12345::",
             "g::1", "", "host", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", " 9.9.9.9 "]
    rnd = random.Random(1)
    texts += [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(40)]
    got = {r["ip"]: r["b"] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select(
        "ip", address_bits(F.col("ip")).alias("b")).collect()}
    assert got == {t: bits_of(t) for t in texts}


def test_longest_prefix(spark):
    rnd = random.Random(2)
    nets = {"0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "2001:db8::/32", "2001:db8:1::/48",
            "2001:db8:1:2::/64", "::ffff:0:0/96"}
    for _ in range(60):
        nets.add(str(ipaddress.ip_network((f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}.0", rnd.randint(12, 28)), strict=False)))
        nets.add(str(ipaddress.ip_network((f"2001:db8:{rnd.randint(0, 3):x}:{rnd.randint(0, 9):x}::", rnd.randint(30, 70)), strict=False)))
    nets = sorted(nets)
    ips = [f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}" for _ in range(150)] + [
        f"2001:db8:{rnd.randint(0, 3):x}:{rnd.randint(0, 9):x}::{rnd.randint(0, 99):x}" for _ in range(150)] + ["8.8.8.8", "fd00::1", "10.1.2.3"]

    def longest(ip):
        own, best = bits_of(ip), None
        for i, net in enumerate(nets):
            n = ipaddress.ip_network(net)
            length = n.prefixlen + (96 if n.version == 4 else 0)
            if own[:length] == bits_of(str(n.network_address))[:length] and (best is None or (length, -i) > best[:2]):
                best = (length, -i, i)
        return best and best[2]

    table = spark.createDataFrame([*[(n, i) for i, n in enumerate(nets)], ("junk", 999), ("10.0.0.0/99", 998), (None, 997)], "prefix string, asn int")
    addresses = spark.createDataFrame([(i,) for i in ips + ["junk", None]], "ip string")
    got = {r["ip"]: r["asn"] for r in locate_prefixes(addresses, table, ["asn"]).collect()}
    assert got == {ip: longest(ip) for ip in set(ips)}


def test_events_keep_their_rows(spark):
    rows = [event(1, ip="2001:db8::7"), event(2, ip=None), event(3, ip="9.9.9.9"), event(4, ip="nowhere")]
    asn = spark.createDataFrame([("2001:db8::/32", 64500, "six"), ("9.0.0.0/8", 64501, "nine")], "prefix string, asn int, asn_org string")
    got = {r["event_id"]: r["geoip"] for r in enrich_prefixes(events_frame(spark, rows), asn=asn).collect()}
    assert got[1]["asn"] == 64500 and got[1]["country"] is None and got[2] is None and got[3]["asn_org"] == "nine" and got[4]["asn"] is None
    assert enrich_prefixes(events_frame(spark, rows)).columns == events_frame(spark, rows).columns
