"""Queries over packets and packet-log text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeflow.functions import net
from shapeflow.functions.addresses import longest_prefix
from shapeflow.operators import packets as P
from shapeflow.sources import derived, packet_log

SALT = "example"
LOCAL = ["10.137.0.10", "10.137.0.11"]


def _numbered(spark, sf, source=derived.packets, step=P.WINDOW_MS):
    return P.number(P.mark_probes(P.at_ticks(source(spark, sf), step_ms=step)).filter("not probe").drop("probe"))


def windows_sql(step: int = P.WINDOW_MS) -> str:
    return f"""w AS (SELECT *, tick_end - 10000 AS start_ms FROM (SELECT *, unnest(range((t_ms // {step} + 1) * {step}, (t_ms // {step}) * {step} + 10001, {step})) AS tick_end FROM packets)),
m AS (SELECT *, max(length) OVER f = 0 OR (count(*) OVER f <= 2 AND NOT bool_or(out) OVER f) AS probe FROM w WINDOW f AS (PARTITION BY iface, tick_end, flow)),
k AS (SELECT *, min(seq) OVER (PARTITION BY iface, tick_end, flow) AS fs FROM m WHERE NOT probe),
k2 AS (SELECT *, row_number() OVER (PARTITION BY iface, tick_end ORDER BY t_ms, fs, seq) AS pos FROM k),
k3 AS (SELECT *, min(pos) OVER (PARTITION BY iface, tick_end, flow) AS fp, min(pos) OVER (PARTITION BY iface, tick_end, endpoint) AS ep FROM k2),
n AS (SELECT *, dense_rank() OVER (PARTITION BY iface, tick_end ORDER BY fp) AS flow_no, dense_rank() OVER (PARTITION BY iface, tick_end ORDER BY ep) AS endpoint_no, NOT (proto = 6 AND length = 0) AS data FROM k3),
g AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY iface, tick_end ORDER BY pos) AS gap FROM n),
pz AS (SELECT iface, tick_end, count(*) FILTER (gap >= 1000) AS pauses, coalesce(max(gap), 0) AS longest_pause_ms, max(t_ms) - min(t_ms) AS span_ms, CAST(max(endpoint_no) AS BIGINT) AS endpoints FROM g GROUP BY ALL),
fl AS (SELECT iface, tick_end, start_ms, flow_no, arg_min(proto, pos) AS proto, arg_min(endpoint_no, pos) AS endpoint_no, count(*) FILTER (NOT data) AS acks, CAST(sum(length) AS BIGINT) AS bytes, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS packets,
  CAST(sum(CASE WHEN data AND NOT out THEN length ELSE 0 END) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN data AND out THEN length ELSE 0 END) AS BIGINT) AS bytes_out FROM n GROUP BY iface, tick_end, start_ms, flow_no),
su AS (SELECT iface, tick_end, count(*) AS flows, count(*) FILTER (first_ms - start_ms > 200) AS opened, count(*) FILTER (last_ms - first_ms < 2000) AS short_lived, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  CAST(coalesce(100 * max(bytes) // nullif(sum(bytes), 0), 0) AS BIGINT) AS top_share FROM fl GROUP BY iface, tick_end),
summary AS (SELECT * FROM su JOIN pz USING (iface, tick_end))"""


PL = "pl AS (SELECT iface, tick_end, pos AS ord, '+' || (t_ms - coalesce(lag(t_ms) OVER c, start_ms)) || ' f' || flow_no || (CASE WHEN out THEN '>' ELSE '<' END) || ' ' || length AS line FROM n WHERE data WINDOW c AS (PARTITION BY iface, tick_end ORDER BY pos))"
RL = """r1 AS (SELECT *, CASE WHEN lag(flow) OVER c = flow AND lag(out) OVER c = out AND lag(length) OVER c = length THEN 0 ELSE 1 END AS new FROM n WHERE data WINDOW c AS (PARTITION BY iface, tick_end ORDER BY pos)),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY iface, tick_end ORDER BY pos) AS run FROM r1),
r3 AS (SELECT iface, tick_end, start_ms, run, min(pos) AS ord, any_value(flow_no) AS flow_no, any_value(out) AS out, any_value(length) AS length, min(t_ms) AS a, max(t_ms) AS b, count(*) AS n FROM r2 GROUP BY iface, tick_end, start_ms, run),
rl AS (SELECT iface, tick_end, ord, '+' || (a - coalesce(lag(b) OVER (PARTITION BY iface, tick_end ORDER BY run), start_ms)) || ' f' || flow_no || (CASE WHEN out THEN '>' ELSE '<' END) || ' ' || length || (CASE WHEN n > 1 THEN ' x' || n || ' over ' || (b - a) || 'ms' ELSE '' END) AS line FROM r3)"""


def bins_sql(ms: int) -> str:
    return f"b{ms} AS (SELECT iface, tick_end, (bin * 1000000 + flow_no) * 2 + out::INT AS ord, (bin * {ms}) || ' f' || flow_no || (CASE WHEN out THEN '>' ELSE '<' END) || ' ' || count(*) || 'p ' || CAST(sum(length) AS BIGINT) || 'B' AS line FROM (SELECT *, (t_ms - start_ms) // {ms} AS bin FROM n WHERE data) GROUP BY iface, tick_end, bin, flow_no, out)"


HEAD = """rows_ AS (SELECT iface, tick_end, string_agg('f' || flow_no || (CASE WHEN proto = 6 THEN ' tcp ' ELSE ' udp ' END) || 'e' || endpoint_no || ' acks=' || acks, chr(10) ORDER BY flow_no) AS rows_ FROM fl GROUP BY ALL),
head AS (SELECT iface, tick_end, 'summary: ' || flows || ' flows to ' || endpoints || ' endpoints (' || opened || ' opened during the window, ' || short_lived || ' lived under 2 s), ' || packets || ' packets over ' || span_ms || ' ms, ' || bytes_in || ' B in, ' || bytes_out || ' B out, largest flow carries ' || top_share || '% of bytes, ' || pauses || ' pauses of a second or more, longest pause ' || longest_pause_ms || ' ms'
  || chr(10) || 'flows (id proto endpoint, pure-ack count):' || chr(10) || rows_ AS head, flows, endpoints, packets FROM summary JOIN rows_ USING (iface, tick_end))"""


def log_sql(budget: int, step: int, source: str = derived.PACKETS_SQL) -> str:
    plain, b100, b500 = P.PLAIN_TITLE, P.BIN_TITLE % 100, P.BIN_TITLE % 500
    return f"""WITH {source}, {windows_sql(step)}, {PL}, {RL}, {bins_sql(100)}, {bins_sql(500)}, {HEAD},
t AS (SELECT iface, tick_end, 0 AS level, '{plain}' AS title, string_agg(line, chr(10) ORDER BY ord) AS body FROM pl GROUP BY ALL UNION ALL SELECT iface, tick_end, 1, '{plain}', string_agg(line, chr(10) ORDER BY ord) FROM rl GROUP BY ALL
  UNION ALL SELECT iface, tick_end, 2, '{b100}', string_agg(line, chr(10) ORDER BY ord) FROM b100 GROUP BY ALL UNION ALL SELECT iface, tick_end, 3, '{b500}', string_agg(line, chr(10) ORDER BY ord) FROM b500 GROUP BY ALL),
f AS (SELECT iface, tick_end, level, head || chr(10) || title || chr(10) AS h, body, flows, endpoints, packets FROM head JOIN t USING (iface, tick_end)),
ok AS (SELECT *, CAST(floor((length(h) + length(body)) / 1.05::DOUBLE) AS BIGINT) + 1 <= {budget} AS fits FROM f),
pick AS (SELECT *, row_number() OVER (PARTITION BY iface, tick_end ORDER BY fits DESC, CASE WHEN fits THEN level ELSE -level END) AS rn FROM ok),
part AS (SELECT *, left(body, greatest(0, {int(budget * 1.05)} - length(h) - 60)::BIGINT) AS part FROM pick WHERE rn = 1),
cut AS (SELECT *, CASE WHEN contains(part, chr(10)) THEN left(part, length(part) - strpos(reverse(part), chr(10))) ELSE part END AS cut FROM part),
d AS (SELECT iface, tick_end, count(*) FILTER (probe) AS probes_dropped FROM m GROUP BY ALL)
SELECT d.iface, d.tick_end, coalesce(CASE WHEN fits THEN h || body ELSE h || cut || chr(10) || '... ' || ((length(body) - length(replace(body, chr(10), ''))) - (length(cut) - length(replace(cut, chr(10), '')))) || ' more lines omitted' END, 'no packets in this batch') AS text,
  CASE WHEN fits IS NULL THEN 0 WHEN fits THEN level ELSE 4 END AS level, coalesce(packets, 0) AS packets, probes_dropped, coalesce(flows, 0) AS flows, coalesce(endpoints, 0) AS endpoints
FROM d LEFT JOIN cut USING (iface, tick_end)"""


_W = f"WITH {derived.PACKETS_SQL}, {windows_sql()}"
_WS = f"WITH {derived.SPARSE_SQL}, {windows_sql(2000)}"
_PRIVATE = " OR ".join(f"ip BETWEEN {a} AND {b}" for a, b in map(net.bounds, net.PRIVATE_V4))
_NOT = " OR ".join(f"ip BETWEEN {a} AND {b}" for a, b in map(net.bounds, net.NOT_PRIVATE_V4))


def _v4_sql(c: str) -> str:
    return "(" + " + ".join(f"split_part({c}, '.', {i + 1})::BIGINT * {1 << 8 * (3 - i)}" for i in range(4)) + ")"


def _private_sql(c: str) -> str:
    return f"({' OR '.join(f'{_v4_sql(c)} BETWEEN {a} AND {b}' for a, b in map(net.bounds, net.PRIVATE_V4))})"


_LINE = packet_log.LINE
PARSED_SQL = rf"""{derived.LINES_SQL},
x AS (SELECT *, regexp_extract(value, '{_LINE}', ['ts', 'src', 'sport', 'dst', 'dport', 'tcp', 'tlen', 'udp', 'ulen']) AS g, regexp_matches(value, '{_LINE}') AS matched FROM lines),
parsed AS (SELECT iface, seq, matched, CAST(floor(try_cast(nullif(g.ts, '') AS DOUBLE) * 1000) AS BIGINT) AS t_ms, nullif(g.src, '') AS src, try_cast(nullif(g.sport, '') AS INT) AS sport, nullif(g.dst, '') AS dst, try_cast(nullif(g.dport, '') AS INT) AS dport,
  CASE WHEN g.tcp <> '' THEN 6 WHEN g.udp <> '' THEN 17 END AS proto, coalesce(try_cast(nullif(g.tlen, '') AS BIGINT), try_cast(nullif(g.ulen, '') AS BIGINT), 0) AS length FROM x)"""
_LOCAL = ", ".join(f"'{x}'" for x in LOCAL)
ORIENTED_SQL = f"""{PARSED_SQL},
o AS (SELECT *, CASE WHEN src IN ({_LOCAL}) THEN true WHEN dst IN ({_LOCAL}) THEN false WHEN {_private_sql('src')} AND NOT {_private_sql('dst')} THEN true WHEN {_private_sql('dst')} AND NOT {_private_sql('src')} THEN false END AS out FROM parsed WHERE matched),
e AS (SELECT *, CASE WHEN out THEN src ELSE dst END AS lip, CASE WHEN out THEN sport ELSE dport END AS lp, CASE WHEN out THEN dst ELSE src END AS rip, CASE WHEN out THEN dport ELSE sport END AS rp FROM o WHERE out IS NOT NULL)"""


def _id_sql(*parts: str) -> str:
    return f"substr(sha256('{SALT}|' || sha256('{SALT}|' || " + " || '|' || ".join(parts) + ")), 1, 16)"


def s1(spark, sf):
    return packet_log.parse(derived.log_lines(spark, sf)).filter("matched").drop("matched")


def f3(spark, sf):
    return packet_log.to_packets(derived.log_lines(spark, sf), SALT, LOCAL, keep_ips=True)


def f1(spark, sf):
    ips = derived.table(spark, sf, "lineitem").selectExpr("concat_ws('.', l_suppkey % 256, l_partkey % 256, l_linenumber, l_orderkey % 256) AS ip").unionByName(
        derived.table(spark, sf, "lineitem").selectExpr("concat_ws('.', element_at(array(10, 172, 192, 198, 203, 100), cast(l_suppkey % 6 + 1 AS int)), element_at(array(16, 168, 0, 18, 51, 64), cast(l_partkey % 6 + 1 AS int)), element_at(array(0, 2, 100, 113), cast(l_orderkey % 4 + 1 AS int)), l_orderkey % 256) AS ip"))
    return ips.distinct().select("ip", net.is_private_v4(F.col("ip")).alias("private"), net.in_networks(F.col("ip"), ["10.137.99.2/30", "172.16.5.5/12"]).alias("in_nets"))


F1_SQL = f"""WITH i AS (SELECT DISTINCT ip FROM (SELECT (l_suppkey % 256) || '.' || (l_partkey % 256) || '.' || l_linenumber || '.' || (l_orderkey % 256) AS ip FROM lineitem
  UNION ALL SELECT ([10, 172, 192, 198, 203, 100])[l_suppkey % 6 + 1] || '.' || ([16, 168, 0, 18, 51, 64])[l_partkey % 6 + 1] || '.' || ([0, 2, 100, 113])[l_orderkey % 4 + 1] || '.' || (l_orderkey % 256) FROM lineitem)),
v AS (SELECT ip AS t, {_v4_sql('ip')} AS ip FROM i)
SELECT t AS ip, ({_PRIVATE}) AND NOT ({_NOT}) AS private, ip BETWEEN {net.bounds('10.137.99.2/30')[0]} AND {net.bounds('10.137.99.2/30')[1]} OR ip BETWEEN {net.bounds('172.16.5.5/12')[0]} AND {net.bounds('172.16.5.5/12')[1]} AS in_nets FROM v"""


def x4(spark, sf):
    p = packet_log.parse(derived.log_lines(spark, sf)).filter("matched")
    return p.groupBy(net.conversation_key(SALT, F.col("proto"), F.col("src"), F.col("sport"), F.col("dst"), F.col("dport")).alias("conversation")).agg(F.count("*").alias("packets"), F.count_distinct("src").alias("senders"))


_X4 = _id_sql("proto", "least(src || ':' || sport, dst || ':' || dport)", "greatest(src || ':' || sport, dst || ':' || dport)")


def f4(spark, sf):
    routes = derived.table(spark, sf, "lineitem").selectExpr("concat('vif', l_suppkey % 4) AS iface", "CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN '' WHEN 3 THEN concat('10.137.0.', l_suppkey, '/24') WHEN 4 THEN concat('10.137.0.', l_suppkey, '/32') ELSE concat('10.137.1.', l_suppkey % 250) END AS dst")
    return packet_log.routed_hosts(routes)


F4_SQL = """WITH r AS (SELECT 'vif' || (l_suppkey % 4) AS iface, CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN '' WHEN 3 THEN '10.137.0.' || l_suppkey || '/24' WHEN 4 THEN '10.137.0.' || l_suppkey || '/32' ELSE '10.137.1.' || (l_suppkey % 250) END AS dst FROM lineitem)
SELECT DISTINCT iface, split_part(dst, '/', 1) AS host FROM r WHERE dst NOT IN ('', 'default') AND (NOT contains(dst, '/') OR dst LIKE '%/32' OR dst LIKE '%/128')"""


def f9(spark, sf):
    """Allowed links; the deny rule holds for an explicit list too."""
    p = derived.table(spark, sf, "lineitem").selectExpr("concat(element_at(array('vif', 'eth', 'lo', 'wlan'), cast(l_linenumber % 4 + 1 AS int)), l_suppkey % 3) AS iface")
    return packet_log.allowed_links(p, "vif", ("wlan1", "eth1")).groupBy("iface").agg(F.count("*").alias("packets"))


def f5(spark, sf):
    """Local hosts: those of the route table and those that configured networks name."""
    nets = ["10.137.99.2/32", "10.137.99.0/24", "fd00::7/128", "192.168.7.7"]
    named = f4(spark, sf).select("iface").distinct().select("iface", F.explode(F.array(*map(F.lit, packet_log.configured_hosts(nets)))).alias("host"))
    return f4(spark, sf).union(named).distinct()


def _ends(spark, sf):
    return packet_log.parse(derived.dual_stack_lines(spark, sf)).filter("matched").select(F.explode(F.array("src", "dst")).alias("ip"))


def f2_networks(spark, sf):
    return longest_prefix(_ends(spark, sf), "ip", derived.networks(spark, sf)).withColumn("length", F.col("length").cast("long"))


def f1_private(spark, sf):
    return net.private_addresses(_ends(spark, sf), "ip")


#: Kinds of remote addresses that are private: documentation.
_PRIVATE_KINDS = "(5)"
#: Packets of the dual-stack log from the kinds of their addresses, without a look at the line: all hosts are private.
_DUAL_PACKETS = f"""{derived.DUAL_SQL}, e AS (SELECT 'vif' || (l_suppkey % 4) AS iface, {derived._SEQ}, CAST(floor(CAST('17584' || lpad(l_orderkey::VARCHAR, 5, '0') || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS DOUBLE) * 1000) AS BIGINT) AS t_ms,
  l_returnflag <> 'R' AS out, CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS proto, CAST(floor(l_quantity * 29) AS BIGINT) AS length, host AS lip, CAST(40000 + l_suppkey AS INT) AS lp, remote AS rip, 443 AS rp, kind IN {_PRIVATE_KINDS} AS private FROM dual WHERE packet)"""
_V4 = "(({0})::UHUGEINT << 24) + (({1})::UHUGEINT << 16) + (({2})::UHUGEINT << 8) + ({3})::UHUGEINT"
_MAPPED = "(65535::UHUGEINT << 32) + "
#: Addresses and networks as numbers from the arithmetic that made them, and each address's smallest network by a range join.
_NETWORKS_SQL = f"""{derived.DUAL_SQL},
a AS (SELECT DISTINCT host AS ip, CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE 6 END AS version, CASE l_suppkey % 4 WHEN 0 THEN {_V4.format(10, 137, 0, 10)} WHEN 1 THEN ({0xfd000137}::UHUGEINT << 96) + 10 WHEN 2 THEN ({0xfe80}::UHUGEINT << 112) + 65547 ELSE {_MAPPED}{_V4.format(10, 137, 0, 13)} END AS n FROM dual WHERE packet
  UNION SELECT remote, CASE WHEN kind = 0 THEN 4 ELSE 6 END, CASE kind WHEN 0 THEN {_V4.format(93, 184, 5, "l_suppkey % 200")} WHEN 1 THEN ({0x26009000}::UHUGEINT << 96) + ((l_suppkey % 200 + 1)::UHUGEINT << 80) + 1 WHEN 2 THEN ({0x2a001450}::UHUGEINT << 96) + ({0x4001080b}::UHUGEINT << 64) + 8206
    WHEN 3 THEN ({0x20014860}::UHUGEINT << 96) + ({0x4860}::UHUGEINT << 80) + (l_suppkey % 200 + 1)::UHUGEINT WHEN 4 THEN {_MAPPED}{_V4.format(93, 184, "l_suppkey % 7", "l_suppkey % 200")} WHEN 5 THEN ({0x20010db8}::UHUGEINT << 96) + (l_suppkey % 200 + 1)::UHUGEINT
    WHEN 6 THEN ({0x0064ff9b}::UHUGEINT << 96) + ({0x5db8}::UHUGEINT << 16) + (l_suppkey % 200 + 1)::UHUGEINT ELSE ({0x20010030}::UHUGEINT << 96) + (l_suppkey % 200 + 1)::UHUGEINT END FROM dual WHERE packet),
raw AS (SELECT p_partkey AS p, unnest(range(5)) AS k FROM part),
sized AS (SELECT *, CASE k WHEN 0 THEN 20 + p % 9 WHEN 1 THEN 24 + p % 9 WHEN 2 THEN 33 + p % 30 WHEN 3 THEN 112 + p % 17 ELSE 118 + p % 11 END AS l, CASE WHEN k < 2 THEN 4 ELSE 6 END AS version FROM raw),
nets AS (SELECT DISTINCT version, l, CASE k WHEN 0 THEN '10.' || (p % 256) || '.' || (p * 7 % 256) || '.0/' || l WHEN 1 THEN '93.184.' || (p % 7) || '.' || (p * 7 % 256) || '/' || l WHEN 2 THEN '2600:9000:' || format('{{:x}}', p % 256 + 1) || '::/' || l
    WHEN 3 THEN '2001:4860:4860::' || format('{{:x}}', p % 256 + 1) || '/' || l ELSE '::ffff:93.184.' || (p % 7) || '.' || (p % 256) || '/' || l END AS net,
  CASE k WHEN 0 THEN {_V4.format(10, "p % 256", "p * 7 % 256", 0)} WHEN 1 THEN {_V4.format(93, 184, "p % 7", "p * 7 % 256")} WHEN 2 THEN ({0x26009000}::UHUGEINT << 96) + ((p % 256 + 1)::UHUGEINT << 80)
    WHEN 3 THEN ({0x20014860}::UHUGEINT << 96) + ({0x4860}::UHUGEINT << 80) + (p % 256 + 1)::UHUGEINT ELSE {_MAPPED}{_V4.format(93, 184, "p % 7", "p % 256")} END AS n FROM sized),
low AS (SELECT version, l, n // (1::UHUGEINT << (CASE version WHEN 4 THEN 32 ELSE 128 END - l)::UHUGEINT) AS top, min(net) AS net FROM nets GROUP BY ALL),
held AS (SELECT a.ip, max((low.l, low.net)) AS m FROM a JOIN low ON a.version = low.version AND a.n // (1::UHUGEINT << (CASE a.version WHEN 4 THEN 32 ELSE 128 END - low.l)::UHUGEINT) = low.top GROUP BY a.ip),
found AS (SELECT a.ip, m[2] AS net, CAST(m[1] AS BIGINT) AS length FROM a LEFT JOIN held ON a.ip = held.ip)"""


QUERIES = {
    "s1_parse_log": s1,
    "s2_line_counts": lambda s, d: packet_log.line_counts(derived.log_lines(s, d), LOCAL),
    "f1_f2_private_and_networks": f1,
    "f3_x1_x2_x5_oriented_packets": f3,
    "s1_f1_f3_dual_stack_packets": lambda s, d: packet_log.to_packets(derived.dual_stack_lines(s, d), SALT, keep_ips=True),
    "s2_dual_stack_counts": lambda s, d: packet_log.line_counts(derived.dual_stack_lines(s, d)),
    "f1_private_both_versions": f1_private,
    "f2_smallest_networks": f2_networks,
    "f2_f3_oriented_by_networks": lambda s, d: packet_log.with_direction_by(packet_log.parse(derived.dual_stack_lines(s, d)).filter("matched"), derived.networks(s, d)).select("iface", "seq", "t_ms", "src", "dst", "out"),
    "f4_routed_hosts": f4,
    "f5_local_hosts": f5,
    "f9_allowed_links": f9,
    "x4_conversations": x4,
    "f8_probe_filter": lambda s, d: P.mark_probes(P.at_ticks(derived.sparse_packets(s, d))).groupBy(*P.CELL).agg(F.count_if(~F.col("probe")).alias("kept"), F.count_if("probe").alias("dropped")),
    "p2_batch_summary": lambda s, d: P.summary(_numbered(s, d)),
    "p2_sliding_summary": lambda s, d: P.summary(_numbered(s, d, derived.sparse_packets, 2000)),
    "p3_p4_flow_table": lambda s, d: P.flow_table(_numbered(s, d)).drop("label", "start_ms"),
    "w2_pauses": lambda s, d: P.pauses(_numbered(s, d, derived.sparse_packets, 2000)),
    "w3_p5_plain_lines": lambda s, d: P.plain_lines(_numbered(s, d)),
    "w4_p6_run_lines": lambda s, d: P.run_lines(_numbered(s, d)),
    "w5_o4_numbering": lambda s, d: _numbered(s, d, derived.sparse_packets, 2000).select("iface", "tick_end", "seq", "pos", "flow_no", "endpoint_no"),
    "p7_bin_lines": lambda s, d: P.bin_lines(_numbered(s, d), 100).union(P.bin_lines(_numbered(s, d), 500)),
    "p8_packet_log": lambda s, d: P.packet_log(derived.packets(s, d), 900),
    "p9_packet_log_cut": lambda s, d: P.packet_log(derived.packets(s, d), 500, step_ms=P.WINDOW_MS),
    "p1_p10_p11_tumbling_log": lambda s, d: P.packet_log(derived.sparse_packets(s, d), 12_000, step_ms=P.WINDOW_MS),
}
ORACLES = {
    "s1_parse_log": f"WITH {PARSED_SQL} SELECT iface, seq, t_ms, src, sport, dst, dport, proto, length FROM parsed WHERE matched",
    "s2_line_counts": f"WITH {ORIENTED_SQL}, k AS (SELECT iface, count(*) AS n FROM e GROUP BY iface) SELECT p.iface, count(*) AS total_lines, count(*) - coalesce(any_value(k.n), 0) AS skipped_lines FROM parsed p LEFT JOIN k ON p.iface = k.iface GROUP BY p.iface",
    "f1_f2_private_and_networks": F1_SQL,
    "f3_x1_x2_x5_oriented_packets": f"WITH {ORIENTED_SQL} SELECT iface, seq, t_ms, out, proto, {_id_sql('proto', 'lp', 'rip', 'rp')} AS flow, {_id_sql('proto', 'rip', 'rp')} AS endpoint, length, lip || ':' || lp || ' > ' || rip || ':' || rp AS label FROM e",
    "s1_f1_f3_dual_stack_packets": f"WITH {_DUAL_PACKETS} SELECT iface, seq, t_ms, out, proto, {_id_sql('proto', 'lp', 'rip', 'rp')} AS flow, {_id_sql('proto', 'rip', 'rp')} AS endpoint, length, lip || ':' || lp || ' > ' || rip || ':' || rp AS label FROM e WHERE NOT private",
    "s2_dual_stack_counts": f"WITH {derived.DUAL_SQL} SELECT 'vif' || (l_suppkey % 4) AS iface, count(*) AS total_lines, count(*) FILTER (NOT packet OR kind IN {_PRIVATE_KINDS}) AS skipped_lines FROM dual GROUP BY 1",
    "f1_private_both_versions": f"WITH {derived.DUAL_SQL} SELECT DISTINCT host AS ip, true AS private FROM dual WHERE packet UNION SELECT DISTINCT remote, kind IN {_PRIVATE_KINDS} FROM dual WHERE packet",
    "f2_smallest_networks": f"WITH {_NETWORKS_SQL} SELECT * FROM found",
    "f2_f3_oriented_by_networks": f"""WITH {_NETWORKS_SQL}, o AS (SELECT 'vif' || (l_suppkey % 4) AS iface, {derived._SEQ}, CAST(floor(CAST('17584' || lpad(l_orderkey::VARCHAR, 5, '0') || '.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS DOUBLE) * 1000) AS BIGINT) AS t_ms,
  CASE WHEN l_returnflag = 'R' THEN remote ELSE host END AS src, CASE WHEN l_returnflag = 'R' THEN host ELSE remote END AS dst, kind IN {_PRIVATE_KINDS} AS private, l_returnflag <> 'R' AS outwards FROM dual WHERE packet)
SELECT iface, seq, t_ms, src, dst, CASE WHEN s.net IS NOT NULL THEN true WHEN d.net IS NOT NULL THEN false WHEN private THEN NULL ELSE outwards END AS out FROM o JOIN found s ON s.ip = o.src JOIN found d ON d.ip = o.dst""",
    "f4_routed_hosts": F4_SQL,
    "f5_local_hosts": f"WITH a AS ({F4_SQL}) SELECT iface, host FROM a UNION SELECT iface, unnest(['10.137.99.2', 'fd00::7', '192.168.7.7']) AS host FROM (SELECT DISTINCT iface FROM a)",
    "f9_allowed_links": "SELECT iface, count(*) AS packets FROM (SELECT (['vif', 'eth', 'lo', 'wlan'])[l_linenumber % 4 + 1] || (l_suppkey % 3) AS iface FROM lineitem) WHERE iface LIKE 'vif%' OR iface = 'wlan1' GROUP BY iface",
    "x4_conversations": f"WITH {PARSED_SQL} SELECT {_X4} AS conversation, count(*) AS packets, count(DISTINCT src) AS senders FROM parsed WHERE matched GROUP BY 1",
    "f8_probe_filter": f"{_WS} SELECT iface, tick_end, count(*) FILTER (NOT probe) AS kept, count(*) FILTER (probe) AS dropped FROM m GROUP BY ALL",
    "p2_batch_summary": f"{_W} SELECT * FROM summary",
    "p2_sliding_summary": f"{_WS} SELECT * FROM summary",
    "p3_p4_flow_table": f"{_W} SELECT * EXCLUDE (start_ms) FROM fl",
    "w2_pauses": f"{_WS} SELECT * EXCLUDE (endpoints) FROM pz",
    "w3_p5_plain_lines": f"{_W}, {PL} SELECT * FROM pl",
    "w4_p6_run_lines": f"{_W}, {RL} SELECT * FROM rl",
    "w5_o4_numbering": f"{_WS} SELECT iface, tick_end, seq, pos, flow_no, endpoint_no FROM n",
    "p7_bin_lines": f"{_W}, {bins_sql(100)}, {bins_sql(500)} SELECT * FROM b100 UNION ALL SELECT * FROM b500",
    "p8_packet_log": log_sql(900, 2000),
    "p9_packet_log_cut": log_sql(500, 10_000),
    "p1_p10_p11_tumbling_log": log_sql(12_000, 10_000, derived.SPARSE_SQL),
}
