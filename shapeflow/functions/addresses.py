"""Addresses of both versions as sortable keys, and their networks, as column expressions and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeflow.functions.net import bounds, ipv4_number, is_private_number, is_private_v4
from shapeflow.session import store

#: IPv6 networks that count as private, and networks within them that do not. Fixed values.
PRIVATE_V6 = ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
NOT_PRIVATE_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: What an IPv4 address within an IPv6 one begins with, as 24 hex digits.
MAPPED = "0" * 20 + "ffff"
#: How the text of each private IPv6 address begins, and that of some others.
MAY_BE_PRIVATE = "^(?i)(?:0{0,4}:|0{0,2}64:ff9b:0{0,3}1:|0?100:|2001:(?:0{0,2}[0-9a-f]{0,2}|0?[01][0-9a-f]{2}|0?db8):|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
#: Whole IPv6 addresses of networks that are private throughout and are told by their first groups.
_G = "[0-9a-f]{1,4}"
PRIVATE_V6_TEXT = f"^(?i)(?=f[cd][0-9a-f]{{2}}:|fe[89ab][0-9a-f]:|2002:|2001:0?db8:)(?:{_G}(?::{_G}){{7}}|{_G}(?::{_G}){{0,6}}::|(?=(?:[^:]*:){{2,7}}[^:]*$){_G}(?::{_G})*::{_G}(?::{_G})*)\\z"
#: An IPv4 address within an IPv6 one, as it is mostly written.
MAPPED_TEXT = "^(?i)::ffff:[0-9]+[.][0-9.]+$"
#: Groups of hex digits, with one gap at most.
SHAPE = "^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 hex digits, whose order is that of the numbers; null for anything but an IPv6 address.

    All groups get their leading zeros and lose their colons at once, so that colons stay where the gap is; the text's shape is tested by one pattern.
    """
    padded = lambda text: F.regexp_replace(F.regexp_replace(F.concat(F.lit(":"), text), "([0-9a-f]+)", "000$1"), ":0*([0-9a-f]{4})", "$1")

    def filled(groups: Column) -> Column:
        left, right = F.substring_index(groups, ":", 1), F.substring_index(groups, ":", -1)
        missing = F.lit(32) - F.length(right)
        return F.when(F.contains(groups, F.lit(":")), F.when(F.length(left) <= missing - 4, F.concat(F.rpad(left, missing, F.lit("0")), right))).when(F.length(groups) == 32, groups)

    def shaped(text: Column) -> Column:
        return F.when(text.rlike(SHAPE), bound(padded(text), filled))

    text = F.lower(ip)
    last = F.substring_index(text, ":", -1)  # the last two groups may be written as an IPv4 address
    tail = lambda n: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(last)), _hex(F.shiftright(n, 16), 4), F.lit(":"), _hex(n % 65536, 4))
    return F.when(F.contains(text, F.lit(".")), bound(bound(ipv4_number(last), tail), shaped)).otherwise(shaped(text))


def address_key(ip: Column) -> Column:
    """``4`` and 8 hex digits, or ``6`` and 32; null for text that is no address. Keys of one version sort as the addresses do."""
    return F.when(F.contains(ip, F.lit(":")), F.concat(F.lit("6"), ipv6_hex(ip))).otherwise(F.concat(F.lit("4"), _hex(ipv4_number(ip), 8)))


def between_any(digits: Column, nets: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for low, high in map(bounds, nets):
        out = out | digits.between(f"{low:032x}", f"{high:032x}")
    return out


def is_private_hex(digits: Column) -> Column:
    """Whether an IPv6 address, as hex digits, is private; one that holds an IPv4 address is what that one is."""
    own = between_any(digits, PRIVATE_V6) & ~between_any(digits, NOT_PRIVATE_V6)
    return F.when(digits.startswith(MAPPED), is_private_number(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))).otherwise(own)


def parsed_address(ip: Column) -> Column:
    """struct(v4 number, v6 hex digits): at most one is set, and none of IPv6 addresses whose first groups tell that they are not private."""
    colon = F.contains(ip, F.lit(":"))
    return F.struct(F.when(~colon, ipv4_number(ip)).alias("v4"), F.when(colon & ip.rlike(MAY_BE_PRIVATE), ipv6_hex(ip)).alias("v6"))


def is_private_address(parsed: Column) -> Column:
    """Whether a ``parsed_address`` is private; false for text that is no address."""
    return F.when(parsed["v4"].isNotNull(), is_private_number(parsed["v4"])).when(parsed["v6"].isNotNull(), is_private_hex(parsed["v6"])).otherwise(False)


def is_private_text(ip: Column) -> Column:
    """``is_private_address`` of text, which patterns decide for all but a few networks; only the rest becomes numbers."""
    others = bound(parsed_address(ip), is_private_address)
    return (
        F.when(ip.isNull(), False).when(~F.contains(ip, F.lit(":")), is_private_v4(ip)).when(ip.rlike(MAPPED_TEXT), is_private_v4(F.substring(ip, 8, 99)))
        .when(~ip.rlike(MAY_BE_PRIVATE), False).when(ip.rlike(PRIVATE_V6_TEXT), True).otherwise(others)
    )


def truncated(key: Column, length: Column) -> Column:
    """The first ``length`` bits of a key, as text that starts with the version: equal for addresses of one network of that length."""
    whole = F.floor(length / 4).cast("int")
    digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - length % 4).cast("int")
    part = F.when(length % 4 == 0, F.lit("")).otherwise(F.lower(F.hex(digit - digit % step)))
    return F.concat(F.substring(key, F.lit(1), whole + 1), part)


def network_index(networks: DataFrame, column: str = "net") -> DataFrame:
    """(version, length, prefix, net) of networks written as address/length or as plain addresses; host bits are
    masked off, and of the ways to write one network the first in order stays. Text that is no network is left out."""
    parts = F.split(column, "/")
    most = F.when(F.col("version") == "4", 32).otherwise(128)
    n = networks.select(column, F.explode(F.array(address_key(F.get(parts, F.lit(0))))).alias("key"))  # no filter on the key passes the generator
    n = n.select(F.col(column).alias("net"), "key", F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("int")).alias("written"), F.size(parts).alias("parts")).withColumn("version", F.substring("key", 1, 1))
    n = n.filter(F.col("key").isNotNull() & ((F.col("parts") == 1) | (F.col("parts") == 2) & F.col("written").between(0, most))).withColumn("length", F.coalesce("written", most))
    return n.groupBy("version", "length", truncated(F.col("key"), F.col("length")).alias("prefix")).agg(F.min("net").alias("net"))


def longest_prefix(addresses: DataFrame, column: str, networks: DataFrame) -> DataFrame:
    """(column, net, length) for each distinct address: the smallest network of a table that holds it, null where none does.

    An equi-join on prefixes: an address stands once for each length that networks of its version have (161 at most),
    so neither the number of networks nor that of addresses makes pairs, and a network that holds a third of all
    addresses is one row on its side, beside which adaptive execution can split the other. Only the lengths are collected into one row a version.
    Index and distinct addresses are written, as both are read twice; addresses get their keys once they are distinct.
    """
    index = store(network_index(networks), "networks")
    lengths = index.groupBy("version").agg(F.collect_set("length").alias("lengths"))
    own = addresses.select(F.col(column).alias("_a")).filter(F.col("_a").isNotNull()).distinct()
    own = store(own.select("_a", F.explode(F.array(address_key(F.col("_a")))).alias("key")), "addresses")
    tried = own.filter(F.col("key").isNotNull()).withColumn("version", F.substring("key", 1, 1)).join(F.broadcast(lengths), "version").withColumn("length", F.explode("lengths"))  # two rows
    found = tried.withColumn("prefix", truncated(F.col("key"), F.col("length"))).join(index, ["version", "length", "prefix"])
    best = found.groupBy("_a").agg(F.max(F.struct("length", "net")).alias("m"))
    return own.join(best, "_a", "left").select(F.col("_a").alias(column), F.col("m.net").alias("net"), F.col("m.length").alias("length"))
