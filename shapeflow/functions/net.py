"""Addresses and salted ids as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IPv4 networks that count as private, and addresses within them that do not. Fixed values.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32")
NOT_PRIVATE_V4 = ("192.0.0.9/32", "192.0.0.10/32")
#: Four decimal bytes without leading zeros, and how the text of private addresses begins.
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
PRIVATE_V4_TEXT = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.(?:0\.[02]|168)|198\.(?:1[89]|51\.100)|203\.0\.113|2[45][0-9])\."


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null for anything but four decimal bytes without leading zeros."""
    ok = ip.rlike(IPV4)
    part = lambda i: F.substring_index(F.substring_index(ip, ".", i + 1), ".", -1).try_cast("long")
    number = sum((part(i) * (1 << 8 * (3 - i)) for i in range(1, 4)), part(0) * (1 << 24))
    return F.when(ok, number)


def bounds(cidr: str) -> tuple[int, int]:
    """First and last address; host bits are masked off."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def number_in(number: Column, cidrs: tuple[str, ...] | list[str]) -> Column:
    """Whether an address, as a number, lies in any of the networks; false for null."""
    out = F.lit(False)
    for low, high in map(bounds, cidrs):
        out = out | number.between(low, high)
    return F.coalesce(out, F.lit(False))


def in_networks(ip: Column, cidrs: tuple[str, ...] | list[str]) -> Column:
    """Whether an IPv4 address lies in any of the networks; false for other text.

    The one-element array binds the number once, so that it is not computed anew for each network.
    """
    return F.element_at(F.transform(F.array(ipv4_number(ip)), lambda number: number_in(number, cidrs)), 1)


def is_private_v4(ip: Column) -> Column:
    """Whether an IPv4 address is private, by patterns of its text, without a number; false for other text."""
    return F.coalesce(ip.rlike(PRIVATE_V4_TEXT) & ip.rlike(IPV4) & ~ip.isin(*(net.split("/")[0] for net in NOT_PRIVATE_V4)), F.lit(False))


def is_private_number(number: Column) -> Column:
    """``is_private_v4`` of an address that is a number already."""
    return number_in(number, PRIVATE_V4) & ~number_in(number, NOT_PRIVATE_V4)


def private_addresses(addresses: DataFrame, column: str) -> DataFrame:
    """(column, private) for each distinct address of either version; false for text that is no address."""
    from shapeflow.functions.addresses import is_private_text

    distinct = addresses.select(column).filter(F.col(column).isNotNull()).distinct()
    return distinct.select(column, is_private_text(F.col(column)).alias("private"))


def salted_id(salt: str, *parts: Column) -> Column:
    """16 hex digits that stand for the parts under a salt; equal parts, equal ids."""
    inner = F.sha2(F.concat_ws("|", F.lit(salt), *(p.cast("string") for p in parts)), 256)
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), inner), 256), 1, 16)


def flow_id(salt: str, proto: Column, local_port: Column, remote_ip: Column, remote_port: Column) -> Column:
    return salted_id(salt, proto, local_port, remote_ip, remote_port)


def endpoint_id(salt: str, proto: Column, remote_ip: Column, remote_port: Column) -> Column:
    return salted_id(salt, proto, remote_ip, remote_port)


def host_id(salt: str, ip: Column) -> Column:
    return salted_id(salt, ip)


def conversation_key(salt: str, proto: Column, a_ip: Column, a_port: Column, b_ip: Column, b_port: Column) -> Column:
    """One id for both directions of a conversation."""
    a, b = F.concat_ws(":", a_ip, a_port), F.concat_ws(":", b_ip, b_port)
    return salted_id(salt, proto, F.least(a, b), F.greatest(a, b))
