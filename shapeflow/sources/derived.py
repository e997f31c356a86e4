"""Packet, answer and sample tables derived from the driver's star-schema tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The catalog's activity names, in order. Fixed values.
ACTIVITIES = ("idle", "unknown", "web browsing", "ssh", "software updates", "chat", "wallet polling rpc", "torrent", "large file upload", "large file download", "claude code")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iface, seq, t_ms, out, proto, flow, endpoint, length, label): four links, six flows each, about ten packets a second."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('vif', l_suppkey % 4) AS iface",
        "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS seq",
        "l_orderkey * 100 + l_linenumber * 7 + l_partkey % 5 AS t_ms",
        "l_returnflag <> 'R' AS out",
        "CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS proto",
        "concat('flow', (l_suppkey div 4) % 6) AS flow",
        "concat('end', (l_suppkey div 4) % 6 % 4) AS endpoint",
        "CASE WHEN l_quantity <= 10 THEN 0L ELSE cast(floor(l_quantity * 29) AS bigint) END AS length",
        "cast(NULL AS string) AS label",
    )


PACKETS_SQL = """packets AS (
  SELECT 'vif' || (l_suppkey % 4) AS iface, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
    l_orderkey * 100 + l_linenumber * 7 + l_partkey % 5 AS t_ms, l_returnflag <> 'R' AS out, CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS proto,
    'flow' || ((l_suppkey // 4) % 6) AS flow, 'end' || ((l_suppkey // 4) % 6 % 4) AS endpoint,
    CASE WHEN l_quantity <= 10 THEN 0 ELSE CAST(floor(l_quantity * 29) AS BIGINT) END AS length, CAST(NULL AS VARCHAR) AS label
  FROM lineitem)"""


def sparse_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from ``events``: seconds read as milliseconds, long pauses, many short flows."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('vif', user_id % 3) AS iface", "event_id AS seq",
        "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS t_ms",
        "event_type <> 'view' AS out", "CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto",
        "concat('flow', user_id % 12) AS flow", "concat('end', user_id % 5) AS endpoint",
        "cast(floor(value * 7) AS bigint) % 1400 AS length", "cast(NULL AS string) AS label",
    )


SPARSE_SQL = """packets AS (
  SELECT 'vif' || (user_id % 3) AS iface, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t_ms, event_type <> 'view' AS out,
    CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto, 'flow' || (user_id % 12) AS flow, 'end' || (user_id % 5) AS endpoint,
    CAST(floor(value * 7) AS BIGINT) % 1400 AS length, CAST(NULL AS VARCHAR) AS label
  FROM events)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iface, seq, value): packet-log text of the packets, with some lines of other kinds between."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('vif', l_suppkey % 4) AS iface",
        "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS seq",
        """CASE WHEN l_linenumber = 7 THEN concat('17584', lpad(l_orderkey, 5, '0'), '.0 IP 10.0.0.1 > 10.0.0.2: ICMP echo request')
             WHEN l_partkey % 97 = 0 THEN 'garbage'
             WHEN l_partkey % 89 = 0 THEN concat('17584', lpad(l_orderkey, 5, '0'), '.5 IP 93.184.1.', l_suppkey % 200, '.443 > 93.184.2.7.80: tcp 9')
             ELSE concat('17584', lpad(l_orderkey, 5, '0'), '.', lpad(l_partkey % 1000, 3, '0'), '000 IP ',
               CASE WHEN l_returnflag = 'R' THEN concat('93.184.', l_suppkey % 7, '.', l_suppkey % 200, '.443') ELSE concat('10.137.0.', 10 + l_suppkey % 4, '.', 40000 + l_suppkey) END, ' > ',
               CASE WHEN l_returnflag <> 'R' THEN concat('93.184.', l_suppkey % 7, '.', l_suppkey % 200, '.443') ELSE concat('10.137.0.', 10 + l_suppkey % 4, '.', 40000 + l_suppkey) END,
               CASE WHEN l_linestatus = 'O' THEN concat(': tcp ', cast(l_quantity * 29 AS int)) ELSE concat(': UDP, length ', cast(l_quantity * 29 AS int)) END) END AS value""",
    )


LINES_SQL = """lines AS (
  SELECT 'vif' || (l_suppkey % 4) AS iface, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
    CASE WHEN l_linenumber = 7 THEN '17584' || lpad(l_orderkey::VARCHAR, 5, '0') || '.0 IP 10.0.0.1 > 10.0.0.2: ICMP echo request'
      WHEN l_partkey % 97 = 0 THEN 'garbage'
      WHEN l_partkey % 89 = 0 THEN '17584' || lpad(l_orderkey::VARCHAR, 5, '0') || '.5 IP 93.184.1.' || (l_suppkey % 200) || '.443 > 93.184.2.7.80: tcp 9'
      ELSE '17584' || lpad(l_orderkey::VARCHAR, 5, '0') || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '000 IP ' ||
        (CASE WHEN l_returnflag = 'R' THEN '93.184.' || (l_suppkey % 7) || '.' || (l_suppkey % 200) || '.443' ELSE '10.137.0.' || (10 + l_suppkey % 4) || '.' || (40000 + l_suppkey) END) || ' > ' ||
        (CASE WHEN l_returnflag <> 'R' THEN '93.184.' || (l_suppkey % 7) || '.' || (l_suppkey % 200) || '.443' ELSE '10.137.0.' || (10 + l_suppkey % 4) || '.' || (40000 + l_suppkey) END) ||
        (CASE WHEN l_linestatus = 'O' THEN ': tcp ' || CAST(floor(l_quantity * 29) AS INT) ELSE ': UDP, length ' || CAST(floor(l_quantity * 29) AS INT) END) END AS value
  FROM lineitem)"""


#: Addresses of the dual-stack log by kind: hosts of the profiled side, and remote ones; {x} is a hex number, {a} and {b} are decimal.
HOSTS = ("10.137.0.10", "fd00:137::a", "fe80::1:b", "::ffff:10.137.0.13")
REMOTES = ("93.184.5.{b}", "2600:9000:{x}::1", "2a00:1450:4001:80b::200e", "2001:4860:4860:0:0:0:0:{x}", "::ffff:93.184.{a}.{b}", "2001:db8::{x}", "64:ff9b::5db8:{x}", "2001:30::{x}")
#: Networks by kind, of which {l} is the length.
NETWORKS = ("10.{p}.{q}.0/{l}", "93.184.{a}.{q}/{l}", "2600:9000:{x}::/{l}", "2001:4860:4860::{x}/{l}", "::ffff:93.184.{a}.{p}/{l}")
NETWORK_LENGTHS = ((20, 9), (24, 9), (33, 30), (112, 17), (118, 11))


def _texts(templates: tuple[str, ...], kind: str, values: dict[str, str]) -> str:
    """SQL for the text of a template chosen by ``kind``, its places filled with the values."""
    import re

    def one(template: str) -> str:
        return "concat(" + ", ".join(values[x[1:-1]] if x.startswith("{") else f"'{x}'" for x in re.split(r"(\{\w\})", template) if x) + ")"

    return f"CASE {kind} " + " ".join(f"WHEN {k} THEN {one(t)}" for k, t in enumerate(templates)) + " END"


def _dual_sql(hex_: str, div: str) -> tuple[tuple[str, str], str]:
    """(a packet's host and remote address) and the line between them, in either engine's SQL."""
    values = {"x": hex_.format("l_suppkey % 200 + 1"), "a": "l_suppkey % 7", "b": "l_suppkey % 200"}
    ends = (f"{_texts(HOSTS, 'l_suppkey % 4', {})} AS host", f"{_texts(REMOTES, f'(l_partkey {div} 3) % 8', values)} AS remote")
    host, remote = "concat(host, '.', 40000 + l_suppkey)", "concat(remote, '.443')"
    line = f"""CASE WHEN l_partkey % 97 = 0 THEN 'garbage' ELSE concat('17584', lpad(cast(l_orderkey AS {{text}}), 5, '0'), '.', lpad(cast(l_partkey % 1000 AS {{text}}), 3, '0'), '000 ',
      CASE WHEN contains(concat(host, remote), ':') THEN 'IP6 ' ELSE 'IP ' END, CASE WHEN l_returnflag = 'R' THEN concat({remote}, ' > ', {host}) ELSE concat({host}, ' > ', {remote}) END,
      CASE WHEN l_linestatus = 'O' THEN ': tcp ' ELSE ': UDP, length ' END, cast(floor(l_quantity * 29) AS int)) END AS value"""
    return ends, line


_SEQ = "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS seq"


def dual_stack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iface, seq, value): packet-log text of links whose hosts speak both address versions."""
    ends, line = _dual_sql("lower(hex({}))", "div")
    return table(spark, sf_dir, "lineitem").selectExpr("*", *ends).selectExpr("concat('vif', l_suppkey % 4) AS iface", _SEQ, line.format(text="string"))


DUAL_SQL = f"""dual AS (SELECT *, {", ".join(_dual_sql("format('{{:x}}', {})", "//")[0])}, l_partkey % 97 <> 0 AS packet, (l_partkey // 3) % 8 AS kind FROM lineitem),
dual_lines AS (SELECT 'vif' || (l_suppkey % 4) AS iface, {_SEQ}, {_dual_sql("format('{{:x}}', {})", "//")[1].format(text="varchar")} FROM dual)"""


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net): five networks of each part, of both versions and many lengths, some within others."""
    values = {"p": "p_partkey % 256", "q": "p_partkey * 7 % 256", "a": "p_partkey % 7", "x": "lower(hex(p_partkey % 256 + 1))", "l": "low + p_partkey % size"}
    lengths = ", ".join(f"struct({k} AS kind, {low} AS low, {size} AS size)" for k, (low, size) in enumerate(NETWORK_LENGTHS))
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"inline(array({lengths}))").selectExpr(_texts(NETWORKS, "kind", values) + " AS net").distinct()


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iface, tick, probabilities, top, confidence, intensity, nouls, input_tokens) from ``events``: 0.7 on one activity, 0.3 spread."""
    keys = F.array(*(F.lit(k.replace(" ", "_")) for k in ACTIVITIES))
    n = len(ACTIVITIES)
    return (
        table(spark, sf_dir, "events")
        .withColumn("turn", F.expr(f"cast((event_id div 40 + user_id % 2) % {n} AS int)"))
        .select(
            F.expr("concat('vif', user_id % 3)").alias("iface"), F.col("event_id").alias("tick"),
            F.map_from_arrays(keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("turn"), F.lit(0.7)).otherwise(F.lit(0.3 / (n - 1))))).alias("probabilities"),
            F.element_at(keys, F.col("turn") + 1).alias("top"), F.lit(0.7).alias("confidence"),
            F.expr("(event_id % 5) / 4").alias("intensity"),
            F.expr("map('just_started', (event_id * 7 % 10) / 10, 'automated', round(value * 10) % 10 / 10)").alias("nouls"),
            F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE 900 + event_id % 300 END").alias("input_tokens"),
        )
    )


_LIST = ", ".join(f"'{a.replace(' ', '_')}'" for a in ACTIVITIES)
ANSWERS_SQL = f"""base AS (SELECT *, 'vif' || (user_id % 3) AS iface, event_id AS tick, CAST((event_id // 40 + user_id % 2) % {len(ACTIVITIES)} AS INT) AS turn FROM events),
keys AS (SELECT unnest([{_LIST}]) AS activity, unnest(range(0, {len(ACTIVITIES)})) AS k),
p AS (SELECT iface, tick, activity, CASE WHEN k = turn THEN 0.7 ELSE 0.3 / {len(ACTIVITIES) - 1} END::DOUBLE AS p FROM base, keys)"""
