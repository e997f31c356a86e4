"""Addresses of both versions and their networks against the standard library's address module."""

import ipaddress
import random

from pyspark.sql import functions as F

from shapeflow.functions import addresses as A
from shapeflow.functions import net as N
from shapeflow.sources import packet_log

ODD = [
    "", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1::3:4:5:6:7:8", "12345::", "g::", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.256", "::01.2.3.4",
    "1.2.3.4:1", ":1:2", "1:2:", "a:b", "::1.2.3.4.5", "1:2:3:4:5:6:7:8::", "::2:3:4:5:6:7:8:9", "fe80::1:", "::.", "1::1.2.3.4:5", "FE80::ABCD", "2600::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "10.1.2.3", "8.8.8.8", "01.2.3.4", "junk",
]


def some_addresses():
    rng, out = random.Random(7), set(ODD)
    for net in (*A.PRIVATE_V6, *A.NOT_PRIVATE_V6, "::ffff:0:0/96"):
        own = ipaddress.ip_network(net)
        for n in (int(own.network_address), int(own.broadcast_address), int(own.network_address) - 1, int(own.broadcast_address) + 1):
            if 0 <= n < 1 << 128:
                out |= {str(ipaddress.IPv6Address(n)), ipaddress.IPv6Address(n).exploded.upper()}
    for _ in range(300):
        n = rng.getrandbits(128) & rng.getrandbits(128) & ~(0xFFFF << 16 * rng.randint(0, 7))
        out |= {str(ipaddress.IPv6Address(n)), ipaddress.IPv6Address(n).exploded, str(ipaddress.IPv4Address(n % 2**32)), "64:ff9b::" + str(ipaddress.IPv4Address(n >> 96))}
        out.add("".join(rng.choice("0123af:::.") for _ in range(rng.randint(1, 20))))
    return sorted(out)


def test_keys_and_private_addresses(spark):
    rows = spark.createDataFrame([(x,) for x in [*some_addresses(), None]], "ip string").select("ip", A.address_key(F.col("ip")).alias("key"), F.explode(F.array(A.parsed_address(F.col("ip")))).alias("p")).select("ip", "key", A.is_private_address(F.col("p")).alias("private")).collect()
    for r in rows:
        try:
            own = ipaddress.ip_address(r["ip"])
            want = (("4%08x" if own.version == 4 else "6%032x") % int(own), own.is_private)
        except ValueError:
            want = (None, False)
        assert (r["key"], r["private"]) == want, r["ip"]
    v6 = sorted((r for r in rows if r["key"] and r["key"][0] == "6"), key=lambda r: r["key"])
    assert [int(ipaddress.ip_address(r["ip"])) for r in v6] == sorted(int(ipaddress.ip_address(r["ip"])) for r in v6)


def test_private_addresses_by_text(spark):
    """The patterns that decide most addresses agree with the standard library, at the edges of all networks too."""
    edges = {str(ipaddress.IPv4Address(n)) for net in (*N.PRIVATE_V4, *N.NOT_PRIVATE_V4, "192.0.0.8/29", "172.16.0.0/12") for low, high in [N.bounds(net)] for n in (low - 1, low, low + 1, high, high + 1) if 0 <= n < 1 << 32}
    groups = ["", "0", "00", "0000", "1", "db8", "0db8", "fd00", "fbff", "fe80", "febf", "fec0", "2001", "2002", "ff9b", "1ff", "200", "64", "0064", "100", "ffff", "10.0.0.1", "8.8.8.8"]
    rng = random.Random(9)
    texts = {":".join(rng.choice(groups) for _ in range(rng.randint(2, 9))) for _ in range(6000)} | {f"{a}:{b}::{c}" for a in groups for b in groups for c in groups[:6]}
    texts |= edges | {"::ffff:" + x for x in edges} | {"::FFFF:10.0.0.1", "::ffff:10.1", "10.0.0", "10.0.0.256"} | set(some_addresses())
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "ip string").select("ip", A.is_private_text(F.col("ip")).alias("private")).collect()
    for r in rows:
        try:
            want = ipaddress.ip_address(r["ip"]).is_private
        except ValueError:
            want = False
        assert r["private"] == want, r["ip"]


def test_private_v4_needs_no_lambda(spark):
    """Patterns decide: a lambda is not compiled, and flow records ask twice a row."""
    rows = spark.createDataFrame([("10.1.2.3",), ("192.0.0.9",), ("10.1.2.3.4",), (None,)], "ip string").select("ip", N.is_private_v4(F.col("ip")).alias("private"))
    assert [r["private"] for r in rows.collect()] == [True, False, False, False]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_distinct_before_they_are_parsed(spark):
    """Keys are made of written distinct addresses and networks; lines between two hosts are counted before their direction is told."""
    ips = spark.createDataFrame([("10.1.2.3",)] * 3 + [("2600::1",)], "ip string")
    found = A.longest_prefix(ips, "ip", spark.createDataFrame([("10.0.0.0/8",)] * 2, "net string"))
    assert {f.split("/")[-2].split("-")[0] for f in found.inputFiles()} == {"addresses", "networks"}
    lines = spark.createDataFrame([("a", 1, "1.5 IP 10.0.0.1.5 > 8.8.8.8.6: tcp 9"), ("a", 2, "junk"), ("a", 3, "1.6 IP 10.0.0.1.7 > 8.8.8.8.6: tcp 9"), ("b", 4, "1.5 IP 9.9.9.9.5 > 8.8.8.8.6: tcp 9")], "iface string, seq long, value string")
    counts = packet_log.line_counts(lines)
    assert sorted(map(tuple, counts.collect())) == [("a", 3, 1), ("b", 1, 1)]
    assert str(counts._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 2


def test_smallest_network_of_each_address(spark):
    rng = random.Random(8)
    nets = ["10.1.2.3/8", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "0.0.0.0/0", "::/0", "2600::/20", "2600:9000::5/33", "2600:9000::5", "fe80::/10", "::ffff:10.0.0.0/104", "junk", "1.2.3.4/33", "1.2.3.4/x", "::/129", "1.2.3.4/5/6", ""]
    nets += [f"{ipaddress.ip_address(rng.getrandbits(32))}/{rng.randint(1, 32)}" for _ in range(150)] + [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randint(1, 128)}" for _ in range(150)]
    own = [x for x in some_addresses() if x][:700] + ["10.1.2.3", "10.1.2.4", "10.200.0.1", "2600:9000::5", "2600:9000::6"]
    got = {r["ip"]: (r["net"], r["length"]) for r in A.longest_prefix(spark.createDataFrame([(x,) for x in own + own], "ip string"), "ip", spark.createDataFrame([(x,) for x in nets], "net string")).collect()}
    assert set(got) == set(own)
    known = []
    for text in nets:
        try:
            known.append((ipaddress.ip_network(text, strict=False), text))
        except ValueError:
            pass
    for x in own:
        try:
            a = ipaddress.ip_address(x)
            held = [(n.prefixlen, t) for n, t in known if n.version == a.version and a in n]
        except ValueError:
            held = []
        most = max((k for k, _ in held), default=None)
        assert got[x] == (min((t for k, t in held if k == most), default=None), most), x


LINES = [
    "1.000 IP6 fd00::10.5000 > 2600::1.443: tcp 100", "1.100 IP6 2600::1.443 > fd00::10.5000: tcp 0", "1.200 IP6 fe80::1.5353 > ff02::fb.5353: UDP, length 45",
    "1.300 IP6 2600::1.443 > 2600::2.5000: tcp 9", "1.400 IP6 fd00::10.5000 > fd00::11.443: tcp 9", "1.500 IP 10.0.0.1.1 > 2600::1.443: tcp 1", "1.600 IP6 ::ffff:10.0.0.1.1 > ::ffff:8.8.8.8.2: tcp 1", "garbage",
]


def test_orientation_of_both_versions(spark):
    lines = spark.createDataFrame([("vif0", k, x) for k, x in enumerate(LINES)], "iface string, seq long, value string")
    rows = {r["seq"]: r["out"] for r in packet_log.to_packets(lines, "s").collect()}
    assert rows == {0: True, 1: False, 2: True, 5: True, 6: True}  # a multicast group is no private address
    counts = packet_log.line_counts(lines).first()
    assert (counts["total_lines"], counts["skipped_lines"]) == (8, 3)
    named = {r["seq"]: r["out"] for r in packet_log.to_packets(lines, "s", local=["2600::1"]).collect()}
    assert named[0] is False and named[1] is True and named[3] is True
    nets = spark.createDataFrame([("2600::/126",), ("fd00::11/128",)], "net string")
    by_table = {r["seq"]: r["out"] for r in packet_log.to_packets(lines, "s", networks=nets).collect()}
    assert by_table == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert packet_log.to_packets(lines, "s", networks=nets.limit(0)).count() == 5
