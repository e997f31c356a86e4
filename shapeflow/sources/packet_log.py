"""Packet-log text: parse, count, orient, anonymise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeflow.functions.addresses import is_private_text, longest_prefix
from shapeflow.functions.net import endpoint_id, flow_id

#: Groups: time, source, source port, destination, destination port, tcp, its length, UDP, its length. Fixed value.
LINE = r"^(\d+\.\d+) IP6? ([0-9a-f.:]+)\.(\d+) > ([0-9a-f.:]+)\.(\d+): (?:(tcp) (\d+)|(UDP), length (\d+))"


MARK = "\x01"


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` (iface, seq, value) with matched, t_ms, src, sport, dst, dport, proto, length; null where a line does not match.

    The pattern is matched once a line: its groups, parted by a mark, leave through a generator,
    which no later filter or column is pushed through.
    """
    groups = F.split(F.regexp_replace(F.translate("value", MARK, ""), f"(?s){LINE}.*", MARK.join(f"${i}" for i in range(1, 10))), MARK)
    g = lines.select("iface", "seq", F.explode(F.array(groups)).alias("g"))
    group = lambda i: F.nullif(F.get("g", i - 1), F.lit(""))
    fields = g.withColumn("matched", F.coalesce(F.size("g") == 9, F.lit(False)))
    return fields.select("iface", "seq", "matched", *(F.when(F.col("matched"), c).alias(name) for name, c in (
        ("t_ms", (group(1).try_cast("double") * 1000).cast("long")), ("src", group(2)), ("sport", group(3).try_cast("int")), ("dst", group(4)), ("dport", group(5).try_cast("int")),
        ("proto", F.when(group(6).isNotNull(), 6).when(group(8).isNotNull(), 17)))),
        F.when(F.col("matched"), F.coalesce(group(7).try_cast("long"), group(9).try_cast("long"))).alias("_length")).withColumn("length", F.coalesce("_length", F.lit(0))).drop("_length")


def line_counts(lines: DataFrame, local: list[str] | None = None) -> DataFrame:
    """Per link: all lines, and those that give no packet, be it that they don't match or that neither host is the profiled side.

    Lines between the same two hosts are counted before their direction is told, once for all of them.
    """
    p = with_direction(parse(lines).groupBy("iface", "src", "dst").agg(F.count("*").alias("n")), local)
    return p.groupBy("iface").agg(F.sum("n").alias("total_lines"), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("n"))), F.lit(0)).alias("skipped_lines"))


def with_direction(parsed: DataFrame, local: list[str] | None = None) -> DataFrame:
    """``out``: true outwards, false inwards, null for packets of other hosts: a local address decides, else the private side is the local one.

    What is known of the two addresses leaves through a generator, behind which nothing computes it again.
    """
    named = lambda side: F.col(side).isin(local or [])
    known = parsed.select("*", F.explode(F.array(F.struct(is_private_text(F.col("src")).alias("src"), is_private_text(F.col("dst")).alias("dst")))).alias("_private"))
    return known.select(*parsed.columns, direction(named("src"), named("dst"), F.col("_private.src"), F.col("_private.dst")).alias("out"))


def direction(local_src: Column, local_dst: Column, private_src: Column, private_dst: Column) -> Column:
    return F.when(local_src, True).when(local_dst, False).when(private_src & ~private_dst, True).when(private_dst & ~private_src, False)


def with_direction_by(parsed: DataFrame, networks: DataFrame) -> DataFrame:
    """The same where the local side is known by a table of networks (net), be they many thousands.

    Each distinct address is looked up once, and what is known of it comes back by two joins on the address.
    """
    ends = parsed.select(F.explode(F.array("src", "dst")).alias("ip"))
    known = longest_prefix(ends, "ip", networks).select("ip", F.col("net").isNotNull().alias("local"), F.explode(F.array(is_private_text(F.col("ip")))).alias("private"))
    side = lambda name: known.select(F.col("ip").alias(name), F.struct("local", "private").alias(f"_{name}"))
    both = parsed.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return both.select(*parsed.columns, direction(F.col("_src.local"), F.col("_dst.local"), F.col("_src.private"), F.col("_dst.private")).alias("out"))


def to_packets(lines: DataFrame, salt: str, local: list[str] | None = None, keep_ips: bool = False, networks: DataFrame | None = None) -> DataFrame:
    """Packets of the profiled side: addresses and ports become salted ids, and stay as a label only with ``keep_ips``.
    The profiled side is told by ``networks`` (net) where they are given, else by the ``local`` addresses."""
    parsed = parse(lines).filter("matched")
    p = (with_direction_by(parsed, networks) if networks is not None else with_direction(parsed, local)).filter(F.col("out").isNotNull())
    side = lambda mine, other: F.when(F.col("out"), F.col(mine)).otherwise(F.col(other))
    p = p.select("*", side("src", "dst").alias("local_ip"), side("sport", "dport").alias("local_port"), side("dst", "src").alias("remote_ip"), side("dport", "sport").alias("remote_port"))
    label = F.concat(F.concat_ws(":", "local_ip", "local_port"), F.lit(" > "), F.concat_ws(":", "remote_ip", "remote_port")) if keep_ips else F.lit(None).cast("string")
    return p.select(
        "iface", "seq", "t_ms", "out", "proto",
        flow_id(salt, F.col("proto"), F.col("local_port"), F.col("remote_ip"), F.col("remote_port")).alias("flow"),
        endpoint_id(salt, F.col("proto"), F.col("remote_ip"), F.col("remote_port")).alias("endpoint"), "length", label.alias("label"),
    )


def routed_hosts(routes: DataFrame) -> DataFrame:
    """(iface, host) of a route table (iface, dst): plain hosts and whole-length networks, not the default route."""
    dst = F.col("dst")
    return routes.filter((dst != "") & (dst != "default") & (~dst.contains("/") | dst.endswith("/32") | dst.endswith("/128"))).select("iface", F.split(dst, "/")[0].alias("host")).distinct()


def configured_hosts(nets: list[str]) -> list[str]:
    """Hosts named by configured networks: plain addresses and whole-length networks, without their length."""
    return sorted({net.split("/")[0] for net in nets if "/" not in net or net.endswith(("/32", "/128"))})


def allowed_links(rows: DataFrame, prefix: str, also: tuple[str, ...] = (), denied: tuple[str, ...] = ("eth", "lo")) -> DataFrame:
    """Rows of links with the prefix, or named in ``also``; links with a denied prefix stay out even if they are named."""
    ok = F.col("iface").startswith(prefix) | F.col("iface").isin(*also)
    for x in denied:
        ok = ok & ~F.col("iface").startswith(x)
    return rows.filter(ok)


def captures(**links: DataFrame) -> DataFrame:
    """Rows of several captures one behind another, each under its link's name."""
    out = None
    for name, rows in links.items():
        own = rows.withColumn("iface", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
