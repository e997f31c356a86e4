"""Queries over segments and window measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeflow.functions import levels as L
from shapeflow.operators import measures as M
from shapeflow.operators import segments as S
from shapeflow.sources import derived

SEGMENTS_SQL = """c1 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER f < 2000 THEN 0 ELSE 1 END AS new FROM packets WINDOW f AS (PARTITION BY iface, flow ORDER BY t_ms, seq)),
c2 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY iface, flow ORDER BY t_ms, seq) AS BIGINT) AS island FROM c1),
c3 AS (SELECT *, (t_ms - min(t_ms) OVER (PARTITION BY iface, flow, island)) // 2000 AS cut FROM c2),
c4 AS (SELECT *, t_ms - lag(t_ms) OVER s AS gap, t_ms - lag(t_ms) OVER o AS own, row_number() OVER s AS nth FROM c3
  WINDOW s AS (PARTITION BY iface, flow, island, cut ORDER BY t_ms, seq), o AS (PARTITION BY iface, flow, island, cut, out ORDER BY t_ms, seq)),
segs AS (SELECT iface, flow AS key, arg_min(endpoint, nth) AS endpoint, island, cut, min(t_ms) AS first_ms, max(t_ms) AS last_ms, arg_min(proto, nth) AS protocol, count(*) FILTER (out) AS up_packets, count(*) FILTER (NOT out) AS down_packets,
  CAST(coalesce(sum(length) FILTER (out), 0) AS BIGINT) AS up_bytes, CAST(coalesce(sum(length) FILTER (NOT out), 0) AS BIGINT) AS down_bytes, avg(length) AS mean_ps, coalesce(stddev_samp(length), 0) AS stddev_ps, min(length) AS min_ps, max(length) AS max_ps,
  coalesce(avg(gap), 0) AS mean_piat_ms, coalesce(stddev_samp(gap), 0) AS stddev_piat_ms, coalesce(max(gap), 0)::DOUBLE AS max_piat_ms,
  coalesce(avg(own) FILTER (out), 0) AS up_mean_piat_ms, coalesce(stddev_samp(own) FILTER (out), 0) AS up_stddev_piat_ms, coalesce(avg(own) FILTER (NOT out), 0) AS down_mean_piat_ms, coalesce(stddev_samp(own) FILTER (NOT out), 0) AS down_stddev_piat_ms,
  CASE WHEN island = 1 AND cut = 0 THEN 1 ELSE 0 END AS syn,
  list(CASE WHEN out THEN 0 ELSE 1 END ORDER BY nth) FILTER (nth <= 10) AS splt_direction, list(length ORDER BY nth) FILTER (nth <= 10) AS splt_ps, list(coalesce(gap, 0) ORDER BY nth) FILTER (nth <= 10) AS splt_piat_ms
  FROM c4 GROUP BY iface, flow, island, cut)"""
_TICKS = "range(CAST(ceil((last_ms - 2250) / 2000) AS BIGINT) * 2000, CAST(floor((last_ms + 10000) / 2000) AS BIGINT) * 2000 + 1, 2000)"
MEASURES_SQL = f"""e1 AS (SELECT *, max(last_ms) OVER (PARTITION BY iface, key ORDER BY last_ms, first_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM segs),
e2 AS (SELECT *, sum(CASE WHEN last_ms - before > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY iface, key ORDER BY last_ms, first_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS era FROM e1),
e3 AS (SELECT *, first_value(first_ms) OVER (PARTITION BY iface, key, era ORDER BY last_ms, first_ms) AS first_seen_ms, up_packets + down_packets AS packets,
  list_filter(splt_ps, lambda x : x > 0) AS sample, list_filter(list_zip(splt_direction, splt_ps), lambda x : x[2] > 64) AS dz FROM e2),
e4 AS (SELECT * EXCLUDE (sample, dz), CASE WHEN len(sample) > 0 THEN len(list_filter(sample, lambda x : x <= 100)) / len(sample) ELSE (mean_ps <= 100)::INT END AS tiny, CASE WHEN len(sample) > 0 THEN len(list_filter(sample, lambda x : x >= 1000)) / len(sample) ELSE (mean_ps >= 1000)::INT END AS large,
  greatest(len(dz) - 1, 0) AS pairs, len(list_filter(range(2, len(dz) + 1), lambda i : dz[i][1] <> dz[i - 1][1])) AS changes FROM e3),
mem AS (SELECT *, tick_end - 10000 AS start_ms FROM (SELECT *, unnest({_TICKS}) AS tick_end FROM e4)),
spine AS (SELECT iface, unnest(range(min(CAST(ceil((last_ms - 2250) / 2000) AS BIGINT)) * 2000, max(CAST(floor((last_ms + 10000) / 2000) AS BIGINT)) * 2000 + 1, 2000)) AS tick_end FROM e4 GROUP BY iface),
fk AS (SELECT iface, tick_end, start_ms, key, max(last_ms) - min(least(first_ms, first_seen_ms)) AS life, sum(up_bytes + down_bytes) AS bytes, sum(syn) > 0 OR min(least(first_ms, first_seen_ms)) >= start_ms AS new FROM mem GROUP BY iface, tick_end, start_ms, key),
fm AS (SELECT iface, tick_end, count(*) AS flows, avg(life) AS mean_lifetime_ms, avg(new::INT) AS new_flow_frac, coalesce(max(bytes) / nullif(sum(bytes), 0), 0)::DOUBLE AS top_flow_share FROM fk GROUP BY iface, tick_end),
mm AS (SELECT *, sum(mean_ps * packets) OVER w / sum(packets) OVER w AS mu, CASE WHEN up_packets > 1 AND up_mean_piat_ms > 0 THEN up_packets - 1 ELSE 0 END AS un, CASE WHEN down_packets > 1 AND down_mean_piat_ms > 0 THEN down_packets - 1 ELSE 0 END AS dn FROM mem WINDOW w AS (PARTITION BY iface, tick_end)),
sm AS (SELECT iface, tick_end, count(DISTINCT endpoint) AS endpoints, CAST(sum(up_bytes) AS BIGINT) AS up_bytes, CAST(sum(down_bytes) AS BIGINT) AS down_bytes, CAST(sum(up_packets) AS BIGINT) AS up_packets, CAST(sum(down_packets) AS BIGINT) AS down_packets,
  sum(mean_ps * packets) / sum(packets) AS mean_ps, sqrt(greatest(sum((stddev_ps ** 2 + (mean_ps - mu) ** 2) * packets) / sum(packets), 0)) AS sd, sum(tiny * packets) / sum(packets) AS tiny_frac, sum(large * packets) / sum(packets) AS large_frac,
  coalesce(sum(CASE WHEN packets > 1 THEN mean_piat_ms * (packets - 1) END) / nullif(sum(CASE WHEN packets > 1 THEN packets - 1 END), 0), 0) AS mean_piat_ms,
  coalesce(sum(CASE WHEN un > 0 THEN up_stddev_piat_ms / up_mean_piat_ms * un ELSE 0 END + CASE WHEN dn > 0 THEN down_stddev_piat_ms / down_mean_piat_ms * dn ELSE 0 END) / nullif(sum(un + dn), 0), 0) AS piat_cv,
  sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) / sum(packets) AS tcp_frac, sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) / sum(packets) AS udp_frac, coalesce(sum(changes) / nullif(sum(pairs), 0), 0) AS alternation FROM mm GROUP BY iface, tick_end),
b1 AS (SELECT *, greatest(first_ms, start_ms) AS a FROM mem), b2 AS (SELECT *, least(greatest(last_ms, a), tick_end) AS b FROM b1),
b3 AS (SELECT *, CASE WHEN last_ms > first_ms THEN least(1.0, greatest(0.0, (b - a) / (last_ms - first_ms)))::DOUBLE ELSE 1.0 END AS f, least(39, greatest(0, (a - start_ms) // 250)) AS i0, least(39, greatest(0, (b - start_ms) // 250)) AS i1 FROM b2),
b4 AS (SELECT iface, tick_end, bin, sum(packets * f / (i1 - i0 + 1)) AS packets, sum(up_packets * f / (i1 - i0 + 1)) AS up FROM (SELECT *, unnest(range(i0, i1 + 1)) AS bin FROM b3) GROUP BY iface, tick_end, bin),
bins AS (SELECT g.iface, g.tick_end, g.bin, coalesce(packets, 0.0)::DOUBLE AS packets, coalesce(up, 0.0)::DOUBLE AS up FROM (SELECT iface, tick_end, unnest(range(0, 40)) AS bin FROM (SELECT DISTINCT iface, tick_end FROM mem)) g LEFT JOIN b4 USING (iface, tick_end, bin)),
r1 AS (SELECT *, round(packets, 9) >= 0.5 AS active FROM bins), r2 AS (SELECT *, CASE WHEN lag(active) OVER o = active THEN 0 ELSE 1 END AS new FROM r1 WINDOW o AS (PARTITION BY iface, tick_end ORDER BY bin)),
r3 AS (SELECT *, sum(new) OVER (PARTITION BY iface, tick_end ORDER BY bin) AS run FROM r2),
runs AS (SELECT iface, tick_end, run, any_value(active) AS active, count(*) AS n, min(bin) AS a, max(bin) AS z FROM r3 GROUP BY iface, tick_end, run),
bm AS (SELECT iface, tick_end, coalesce(sum(n) FILTER (active), 0) / 40 AS active_bin_frac, count(*) FILTER (active) AS bursts, coalesce(max(n) FILTER (active) * 250, 0) AS longest_burst_ms, coalesce(median(n) FILTER (active) * 250, 0) AS typical_burst_ms, coalesce(max(n) FILTER (NOT active) * 250, 0) AS longest_gap_ms,
  count(*) FILTER (NOT active AND n >= 4) AS gaps_over_1s, CASE WHEN count(*) FILTER (NOT active AND a > 0 AND z < 39) >= 2 THEN (stddev_pop(n) FILTER (NOT active AND a > 0 AND z < 39)) / (avg(n) FILTER (NOT active AND a > 0 AND z < 39)) ELSE -1.0 END AS burst_gap_cv, string_agg(tick_end - 10000 + a * 250, ',' ORDER BY a) FILTER (active) AS starts FROM runs GROUP BY iface, tick_end),
um AS (SELECT iface, tick_end, CASE WHEN avg(up) > 0 THEN stddev_pop(up) / avg(up) ELSE 0 END AS up_bin_cv FROM bins GROUP BY iface, tick_end),
nf AS (SELECT iface, endpoint, min(last_ms) AS last_ms FROM segs GROUP BY iface, endpoint), ne AS (SELECT iface, tick_end, count(*) AS new_endpoints FROM (SELECT iface, unnest({_TICKS}) AS tick_end FROM nf) GROUP BY iface, tick_end),
measures AS (SELECT s.iface, s.tick_end, coalesce(flows, 0) AS flows, coalesce(endpoints, 0) AS endpoints, coalesce(new_endpoints, 0) AS new_endpoints, coalesce(up_bytes, 0) AS up_bytes, coalesce(down_bytes, 0) AS down_bytes, coalesce(up_packets, 0) AS up_packets, coalesce(down_packets, 0) AS down_packets,
  coalesce(bursts, 0) AS bursts, coalesce(longest_burst_ms, 0) AS longest_burst_ms, coalesce(mean_ps, 0) AS mean_ps, coalesce(CASE WHEN mean_ps > 0 THEN sd / mean_ps ELSE 0 END, 0) AS ps_cv, coalesce(tiny_frac, 0) AS tiny_frac, coalesce(large_frac, 0) AS large_frac, coalesce(mean_piat_ms, 0) AS mean_piat_ms, coalesce(piat_cv, 0) AS piat_cv,
  coalesce(tcp_frac, 0) AS tcp_frac, coalesce(udp_frac, 0) AS udp_frac, coalesce(alternation, 0) AS alternation, coalesce(active_bin_frac, 0)::DOUBLE AS active_bin_frac, coalesce(typical_burst_ms, 0)::DOUBLE AS typical_burst_ms, coalesce(up_bin_cv, 0) AS up_bin_cv, coalesce(mean_lifetime_ms, 0) AS mean_lifetime_ms, coalesce(new_flow_frac, 0) AS new_flow_frac, coalesce(top_flow_share, 0) AS top_flow_share,
  coalesce(longest_gap_ms, 10000) AS longest_gap_ms, coalesce(gaps_over_1s, 1) AS gaps_over_1s, coalesce(burst_gap_cv, -1)::DOUBLE AS burst_gap_cv, coalesce(starts, '') AS burst_starts, (coalesce(up_bytes, 0) + coalesce(down_bytes, 0)) / 10 AS bytes_per_s, (coalesce(up_packets, 0) + coalesce(down_packets, 0)) / 10 AS packets_per_s
  FROM spine s LEFT JOIN fm USING (iface, tick_end) LEFT JOIN sm USING (iface, tick_end) LEFT JOIN bm USING (iface, tick_end) LEFT JOIN um USING (iface, tick_end) LEFT JOIN ne USING (iface, tick_end))"""

_REAL = ("mean_ps", "ps_cv", "tiny_frac", "large_frac", "mean_piat_ms", "piat_cv", "tcp_frac", "udp_frac", "alternation", "active_bin_frac", "typical_burst_ms", "up_bin_cv", "mean_lifetime_ms", "new_flow_frac", "top_flow_share", "burst_gap_cv", "bytes_per_s", "packets_per_s")
_WHOLE = ("flows", "endpoints", "new_endpoints", "up_bytes", "down_bytes", "up_packets", "down_packets", "bursts", "longest_burst_ms", "longest_gap_ms", "gaps_over_1s")
_SEG_REAL = ("mean_ps", "stddev_ps", "mean_piat_ms", "stddev_piat_ms", "max_piat_ms", "up_mean_piat_ms", "up_stddev_piat_ms", "down_mean_piat_ms", "down_stddev_piat_ms")
_SEG_WHOLE = ("iface", "key", "endpoint", "island", "cut", "first_ms", "last_ms", "protocol", "up_packets", "down_packets", "up_bytes", "down_bytes", "min_ps", "max_ps", "syn")
_SEG_LISTS = ("splt_direction", "splt_ps", "splt_piat_ms")
_SPARSE = f"WITH {derived.SPARSE_SQL}, {SEGMENTS_SQL}"
_DENSE = f"WITH {derived.PACKETS_SQL}, {SEGMENTS_SQL}"


def segs(spark, sf, source=derived.sparse_packets):
    return S.segments(source(spark, sf))


def _rounded(df, whole, real, n=6):
    return df.select(*whole, *(F.round(F.col(c).cast("double") + 1e-9, n).alias(c) for c in real))


def _rounded_sql(whole, real, n=6):
    return ", ".join((*whole, *(f"round(CAST({c} AS DOUBLE) + 1e-9, {n}) AS {c}" for c in real)))


def g1(spark, sf, spread=False):
    s = S.segments(derived.packets(spark, sf), spread)
    s = s.withColumns({c: F.array_join(c, ",") for c in _SEG_LISTS})
    first = ("iface", "key", "island", "cut")
    return _rounded(s, (*first, *(c for c in _SEG_WHOLE if c not in first), *_SEG_LISTS), _SEG_REAL).select(*first, *(c for c in (*_SEG_WHOLE, *_SEG_REAL, *_SEG_LISTS) if c not in first))


def m_all(spark, sf, source=derived.sparse_packets):
    m = M.measures(segs(spark, sf, source))
    return _rounded(m.withColumn("burst_starts", F.array_join("burst_starts_ms", ",")), ("iface", "tick_end", *_WHOLE, "burst_starts"), _REAL)


def shapes(spark, sf):
    return M.shapes(M.measures(segs(spark, sf)))


def rhythm(spark, sf, spread=False):
    m = M.measures(segs(spark, sf))
    return M.minute_rhythm(m, spread).select("iface", "tick_end", F.round("long_gap_cv", 6).alias("long_gap_cv"), "long_bursts")


def shapes_with_rhythm(spark, sf):
    m = M.measures(segs(spark, sf))
    return M.shapes(m, M.minute_rhythm(m)).withColumn("text", L.numbers_free(F.col("text")))


def _shape_sql() -> str:
    words = L.shape_columns()
    parts = []
    import re

    for i, x in enumerate(re.split(r"\{(\w+)\}", L.PROSE)):
        parts.append(x if i % 2 else "'" + x.replace("'", "''") + "'")
    prev = ", ".join(f"coalesce(lag({c}) OVER t, 0)::DOUBLE AS prev_{c}" for c in ("bytes_per_s", "flows", "packets_per_s"))
    return f"""{_SPARSE}, {MEASURES_SQL}, q AS (SELECT *, -1.0 AS long_gap_cv, 0 AS long_bursts, {prev} FROM measures WINDOW t AS (PARTITION BY iface ORDER BY tick_end)),
words AS (SELECT iface, tick_end, {', '.join(f'{q} AS {k}' for k, q in words.items())} FROM q), tx AS (SELECT *, {' || '.join(parts)} AS text FROM words)
SELECT *, CAST(greatest(1, round_even(length(text) / 4, 0)) AS INT) AS tokens FROM tx"""


def j4(spark, sf):
    return M.new_endpoints(segs(spark, sf))


def j5(spark, sf, spread=False):
    return S.first_seen(segs(spark, sf), spread).select("iface", "key", "first_ms", "last_ms", "island", "cut", "first_seen_ms")


def j1(spark, sf):
    s = segs(spark, sf).select("iface", "key", "endpoint", "first_ms", "last_ms")
    return S.drop_own(s, s.filter("key in ('flow3', 'flow7')"), s.filter("endpoint = 'end2'"))


def j2(spark, sf):
    s = segs(spark, sf).select("iface", "key", "first_ms", "last_ms")
    return S.drop_shared(s.filter("iface = 'vif0'"), s.filter("iface <> 'vif0'"))


def s12(spark, sf):
    return S.rebase(segs(spark, sf), 1_700_000_000_000, 2.5).select("iface", "key", "island", "cut", "new_first_ms", "new_last_ms")


#: A flow record of each line of ``lineitem``: two hosts, SYN and RST counts, both ways.
RECORD = (
    "concat('vif', l_suppkey % 3) AS iface", "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) AS bigint) AS arrival_seq",
    "concat('conv', l_suppkey % 40, '-', l_linenumber % 4) AS conv_key",
    "CASE WHEN l_partkey % 2 = 0 THEN concat('10.137.0.', l_suppkey % 40) ELSE concat('8.8.', l_linenumber % 4, '.', l_suppkey % 40) END AS src_ip", "CASE WHEN l_partkey % 31 = 0 THEN '239.192.255.254' WHEN l_partkey % 2 = 1 THEN concat('10.137.0.', l_suppkey % 40) ELSE concat('8.8.', l_linenumber % 4, '.', l_suppkey % 40) END AS dst_ip",
    "5000 AS src_port", "CASE WHEN l_partkey % 31 = 0 THEN 65530 ELSE 5000 END AS dst_port", "element_at(array(6, 17, 6, 1), cast(l_orderkey % 4 + 1 AS int)) AS protocol",
    "cast(l_quantity % 7 AS bigint) AS src2dst_packets", "cast(l_quantity % 5 AS bigint) AS dst2src_packets", "cast(l_quantity % 3 = 0 AS int) AS src2dst_syn_packets", "cast(l_quantity % 4 = 0 AS int) AS dst2src_syn_packets",
    "cast(l_quantity % 7 + l_quantity % 5 AS bigint) AS bidirectional_packets", "cast((l_quantity % 7 + l_quantity % 5) * (l_partkey % 120) AS bigint) AS bidirectional_bytes", "cast(l_partkey % 3 AS int) AS bidirectional_rst_packets",
)


def records(spark, sf):
    """Flow records derived from orders of ``lineitem``."""
    return derived.table(spark, sf, "lineitem").selectExpr(*RECORD)


RECORDS_SQL = """rec AS (SELECT 'vif' || (l_suppkey % 3) AS iface, (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS arrival_seq, 'conv' || (l_suppkey % 40) || '-' || (l_linenumber % 4) AS conv_key,
  CASE WHEN l_partkey % 2 = 0 THEN '10.137.0.' || (l_suppkey % 40) ELSE '8.8.' || (l_linenumber % 4) || '.' || (l_suppkey % 40) END AS src_ip, CASE WHEN l_partkey % 31 = 0 THEN '239.192.255.254' WHEN l_partkey % 2 = 1 THEN '10.137.0.' || (l_suppkey % 40) ELSE '8.8.' || (l_linenumber % 4) || '.' || (l_suppkey % 40) END AS dst_ip,
  5000 AS src_port, CASE WHEN l_partkey % 31 = 0 THEN 65530 ELSE 5000 END AS dst_port, ([6, 17, 6, 1])[l_orderkey % 4 + 1] AS protocol, CAST(l_quantity % 7 AS BIGINT) AS sp, CAST(l_quantity % 5 AS BIGINT) AS dp, (l_quantity % 3 = 0) AS ss, (l_quantity % 4 = 0) AS ds,
  CAST(l_quantity % 7 + l_quantity % 5 AS BIGINT) AS n, CAST((l_quantity % 7 + l_quantity % 5) * (l_partkey % 120) AS BIGINT) AS bytes, CAST(l_partkey % 3 AS INT) AS rst FROM lineitem),
dd AS (SELECT *, src_ip || ':' || src_port AS s, dst_ip || ':' || dst_port AS d FROM rec),
d2 AS (SELECT *, CASE WHEN (src_ip = '10.137.0.7') <> (dst_ip = '10.137.0.7') THEN CASE WHEN src_ip = '10.137.0.7' THEN s ELSE d END WHEN ss AND NOT ds THEN s WHEN ds AND NOT ss THEN d END AS dec,
  CASE WHEN src_ip LIKE '10.%' AND dst_ip NOT LIKE '10.%' THEN s WHEN dst_ip LIKE '10.%' AND src_ip NOT LIKE '10.%' THEN d ELSE s END AS guess FROM dd),
d3 AS (SELECT *, coalesce(dec, last_value(dec IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(guess) OVER w, guess) = s AS local_is_src FROM d2 WINDOW w AS (PARTITION BY iface, conv_key ORDER BY arrival_seq))"""

#: Whether a record of RECORDS_SQL is a probe.
PROBE_SQL = """CASE WHEN protocol IN (1, 58) THEN true
  WHEN protocol = 6 THEN (CASE WHEN local_is_src THEN ds AND NOT ss ELSE ss AND NOT ds END) AND rst > 0 AND n > 0 AND bytes < 80 * n
  WHEN n > 4 THEN false WHEN protocol = 17 THEN NOT local_is_src AND (CASE WHEN local_is_src THEN sp ELSE dp END) = 0 ELSE false END"""


def oriented(rows, spread=False):
    from shapeflow.functions.net import in_networks, is_private_v4

    nets = ["10.137.0.7/32"]
    return S.local_is_src(rows, in_networks(F.col("src_ip"), nets), in_networks(F.col("dst_ip"), nets), is_private_v4(F.col("src_ip")), is_private_v4(F.col("dst_ip")), spread)


def w1(spark, sf, spread=False):
    return oriented(records(spark, sf), spread)


def f7(spark, sf):
    r = w1(spark, sf).filter(~S.is_heartbeat())
    return r.select("iface", "arrival_seq", "local_is_src", S.is_probe(F.col("local_is_src")).alias("probe"))


QUERIES = {
    "g1_g2_g3_segments": lambda s, d: g1(s, d, True),
    "g1_segments_in_ranges": lambda s, d: g1(s, d, True),
    "j5_first_seen_in_ranges": lambda s, d: j5(s, d, True),
    "w1_orientation_in_ranges": lambda s, d: w1(s, d, True).select("iface", "arrival_seq", "local_is_src"),
    "m1_m26_measures": m_all,
    "m1_m26_measures_dense": lambda s, d: m_all(s, d, derived.packets),
    "m14_bins": lambda s, d: M.bin_table(M.members(M.prepare(segs(s, d)))).select("iface", "tick_end", "bin", F.round(F.col("packets") + 1e-9, 6).alias("packets"), F.round(F.col("up") + 1e-9, 6).alias("up")),
    "l1_l28_shapes": shapes,
    "w16_m27_minute_rhythm": rhythm,
    "w16_m27_rhythm_in_ranges": lambda s, d: rhythm(s, d, True),
    "l18_shapes_with_rhythm": shapes_with_rhythm,
    "j1_drop_own": j1,
    "j2_drop_shared": j2,
    "j4_new_endpoints": j4,
    "j5_first_seen": j5,
    "s12_rebase": s12,
    "w1_sticky_orientation": lambda s, d: w1(s, d).select("iface", "arrival_seq", "local_is_src"),
    "f6_f7_probe_records": f7,
}
ORACLES = {
    "g1_g2_g3_segments": f"{_DENSE} SELECT {_rounded_sql(_SEG_WHOLE, _SEG_REAL)}, array_to_string(splt_direction, ',') AS splt_direction, array_to_string(splt_ps, ',') AS splt_ps, array_to_string(splt_piat_ms, ',') AS splt_piat_ms FROM segs",
    "m1_m26_measures": f"{_SPARSE}, {MEASURES_SQL} SELECT {_rounded_sql(('iface', 'tick_end', *_WHOLE, 'burst_starts'), _REAL)} FROM measures",
    "m1_m26_measures_dense": f"{_DENSE}, {MEASURES_SQL} SELECT {_rounded_sql(('iface', 'tick_end', *_WHOLE, 'burst_starts'), _REAL)} FROM measures",
    "m14_bins": f"{_SPARSE}, {MEASURES_SQL} SELECT iface, tick_end, CAST(bin AS INT) AS bin, round(packets + 1e-9, 6) AS packets, round(up + 1e-9, 6) AS up FROM bins",
    "l1_l28_shapes": _shape_sql(),
    "j1_drop_own": f"{_SPARSE} SELECT iface, key, endpoint, first_ms, last_ms FROM segs WHERE key NOT IN ('flow3', 'flow7') AND endpoint <> 'end2'",
    "j2_drop_shared": f"{_SPARSE} SELECT iface, key, first_ms, last_ms FROM segs u WHERE iface = 'vif0' AND NOT EXISTS (SELECT 1 FROM segs v WHERE v.iface <> 'vif0' AND v.key = u.key AND v.last_ms BETWEEN u.last_ms - 300000 AND u.last_ms + 1500)",
    "j4_new_endpoints": f"{_SPARSE}, {MEASURES_SQL} SELECT * FROM ne",
    "j5_first_seen": f"{_SPARSE}, {MEASURES_SQL} SELECT iface, key, first_ms, last_ms, island, cut, first_seen_ms FROM e3",
    "s12_rebase": f"{_SPARSE}, o AS (SELECT iface, min(first_ms) AS origin FROM segs GROUP BY iface), z AS (SELECT segs.*, CAST(floor(1700000000000 + (last_ms - origin) / 2.5::DOUBLE) AS BIGINT) AS new_last_ms FROM segs JOIN o USING (iface)) SELECT iface, key, island, cut, new_last_ms - CAST(floor((last_ms - first_ms) / 2.5::DOUBLE) AS BIGINT) AS new_first_ms, new_last_ms FROM z",
    "w1_sticky_orientation": f"WITH {RECORDS_SQL} SELECT iface, arrival_seq, local_is_src FROM d3",
    "f6_f7_probe_records": f"""WITH {RECORDS_SQL} SELECT iface, arrival_seq, local_is_src, {PROBE_SQL} AS probe
FROM d3 WHERE NOT (protocol = 17 AND dst_port = 65530 AND dst_ip = '239.192.255.254')""",
}
#: The plain fold over each link's starts in the order in which they came.
_RHYTHM_SQL = f"""{_SPARSE}, {MEASURES_SQL},
st AS (SELECT iface, tick_end, unnest(string_split(burst_starts, ','))::BIGINT AS b FROM measures WHERE burst_starts <> ''),
fi AS (SELECT iface, b, min(tick_end) AS tick FROM st GROUP BY ALL),
fo AS (SELECT iface, list_reduce(list([{{'tick': tick, 'b': b}}] ORDER BY tick, b), lambda a, x : CASE WHEN len(list_filter(a, lambda y : abs(y.b - x[1].b) < 500)) > 0 THEN a ELSE list_concat(a, x) END) AS noted FROM fi GROUP BY iface),
no AS (SELECT iface, n.tick AS tick, n.b AS b FROM (SELECT iface, unnest(noted) AS n FROM fo)),
mi AS (SELECT m.iface, m.tick_end, no.b, no.b - lag(no.b) OVER (PARTITION BY m.iface, m.tick_end ORDER BY no.b) AS gap FROM measures m JOIN no ON no.iface = m.iface AND no.tick <= m.tick_end AND no.b >= m.tick_end - 60000),
ri AS (SELECT iface, tick_end, count(*) AS long_bursts, CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE -1 END AS long_gap_cv FROM mi GROUP BY ALL)
SELECT m.iface, m.tick_end, round(coalesce(long_gap_cv, -1)::DOUBLE, 6) AS long_gap_cv, coalesce(long_bursts, 0) AS long_bursts FROM measures m LEFT JOIN ri ON ri.iface = m.iface AND ri.tick_end = m.tick_end"""
ORACLES |= {"w16_m27_minute_rhythm": _RHYTHM_SQL, "w16_m27_rhythm_in_ranges": _RHYTHM_SQL}
ORACLES |= {"g1_segments_in_ranges": ORACLES["g1_g2_g3_segments"], "j5_first_seen_in_ranges": ORACLES["j5_first_seen"], "w1_orientation_in_ranges": ORACLES["w1_sticky_orientation"]}
