"""Small fixtures with known outcomes, and properties."""

import pytest
from pyspark.sql import functions as F

from shapeflow.functions import levels, net
from shapeflow.operators import answers as A
from shapeflow.operators import evaluate as E
from shapeflow.operators import measures as M
from shapeflow.operators import packets as P
from shapeflow.operators import segments as S
from shapeflow.sources import derived, packet_log

PACKETS = "iface string, seq long, t_ms long, out boolean, proto int, flow string, endpoint string, length long, label string"


def test_parse_and_orient(spark):
    lines = ["1758412345.123456 IP 10.137.0.10.51000 > 203.0.113.5.443: tcp 1448", "1758412345.223456 IP 203.0.113.5.443 > 10.137.0.10.51000: tcp 0", "1758412346.0 IP 10.137.0.10.5555 > 10.139.1.1.53: UDP, length 56", "1758412346.0 IP 10.137.0.10 > 10.139.1.1: ICMP echo", "garbage", "1758412346.0 IP 1.1.1.1.5 > 2.2.2.2.6: tcp 1"]
    df = spark.createDataFrame([("vif0", i, x) for i, x in enumerate(lines)], "iface string, seq long, value string")
    rows = packet_log.to_packets(df, "s", ["10.137.0.10"], keep_ips=True).orderBy("seq").collect()
    assert [(r["out"], r["proto"], r["length"]) for r in rows] == [(True, 6, 1448), (False, 6, 0), (True, 17, 56)]
    assert rows[0]["flow"] == rows[1]["flow"] and len(rows[0]["flow"]) == 16 and rows[0]["label"] == "10.137.0.10:51000 > 203.0.113.5:443"
    assert all(r["label"] is None for r in packet_log.to_packets(df, "s", ["10.137.0.10"]).collect())
    counts = packet_log.line_counts(df, ["10.137.0.10"]).first()
    assert (counts["total_lines"], counts["skipped_lines"]) == (6, 3)  # ICMP, garbage, foreign hosts


def test_private_addresses(spark):
    import ipaddress

    ips = ["10.1.2.3", "100.64.0.1", "192.0.0.9", "192.0.0.11", "224.0.0.1", "8.8.8.8", "::1", "2001:db8::1", "2600::1", "fe80::1", "junk", "1.2.3", "01.2.3.4"]
    rows = {r["ip"]: r["private"] for r in net.private_addresses(spark.createDataFrame([(x,) for x in ips], "ip string"), "ip").collect()}
    for x in ips:
        try:
            assert rows[x] == ipaddress.ip_address(x).is_private, x
        except ValueError:
            assert rows[x] is False


def test_probes_and_text(spark):
    rows = [("v", 0, 1000, True, 6, "a", "e", 517, None), ("v", 1, 1030, False, 6, "a", "e", 1448, None), ("v", 2, 1040, False, 6, "b", "g", 0, None)] + [("v", 3 + i, 1050 + i, i % 2 == 0, 6, f"s{i // 2}", "h", 0, None) for i in range(6)]
    log = P.packet_log(spark.createDataFrame(rows, PACKETS), step_ms=P.WINDOW_MS).first()
    assert (log["packets"], log["probes_dropped"], log["level"]) == (2, 7, 0)
    assert all(x in log["text"] for x in ("f1 tcp e1 acks=0", "+1000 f1> 517", "+30 f1< 1448", "summary: 1 flows to 1 endpoints"))


@pytest.mark.parametrize("budget", [12000, 4000, 1500, 600])
def test_ladder_keeps_the_budget(spark, budget):
    rows = [("v", 2 * i, 1000 + i, False, 6, "down", "e", 1448, None) for i in range(6000)] + [("v", 2 * i + 1, 1000 + i, True, 6, "down", "e", 0, None) for i in range(0, 6000, 2)] + [("v", 100000 + i, 1200 + 400 * i, i % 2 == 0, 6, "chat", "g", 60 + i * 7 % 50, None) for i in range(12)]
    log = P.packet_log(spark.createDataFrame(rows, PACKETS), budget, step_ms=P.WINDOW_MS).first()
    assert int(len(log["text"]) / 1.05) + 1 <= budget and "f2" in log["text"] and (budget != 12000 or log["level"] in (1, 2))


def test_level_words_hold_no_digit():
    words = [w for edges, top in levels.LEVELS.values() for w in [*(x for _, x in edges), top]] + [w for rules, rest in levels.CHAINS.values() for w in [*(x for _, x in rules), rest]]
    assert not any(c.isdigit() for w in words for c in w)


def test_shapes_of_real_windows(spark):
    m = M.measures(S.segments(derived.sparse_packets(spark, "/root/testdata/sf0.001")))
    shapes = M.shapes(m, M.minute_rhythm(m))
    assert shapes.filter(F.col("text").rlike(r"\d")).isEmpty()
    assert shapes.filter(~F.col("tokens").between(350, 900)).isEmpty()
    silent = shapes.filter("concurrency = 'none'").first()
    assert silent["occupancy"] == "silent" and silent["idle_gap"] == "almost entirely idle"


def test_bins_hold_the_packets_inside(spark):
    segs = S.segments(derived.sparse_packets(spark, "/root/testdata/sf0.001"))
    m = M.members(M.prepare(segs))
    inside = m.filter("first_ms >= start_ms and last_ms <= tick_end").groupBy("iface", "tick_end").agg(F.sum("packets").alias("n"), F.count("*").alias("c"))
    whole = m.groupBy("iface", "tick_end").agg(F.count("*").alias("all"))
    bins = M.bin_table(m).groupBy("iface", "tick_end").agg(F.sum("packets").alias("b"))
    assert inside.join(whole, M.CELL).filter("c = all").join(bins, M.CELL).filter(F.abs(F.col("n") - F.col("b")) > 1e-6).isEmpty()


def answers(spark, tops):
    keys = [f"k{i}" for i in range(30)]
    rows = [("v", t, {k: (p if k == top else (1 - p) / 29) for k in keys}, top, p, 0.5, {"just_started": s}, 10) for t, (top, p, s) in enumerate(tops)]
    return spark.createDataFrame(rows, "iface string, tick long, probabilities map<string,double>, top string, confidence double, intensity double, nouls map<string,double>, input_tokens long"), keys


def test_episodes_and_edges(spark):
    a, keys = answers(spark, [("k0", 0.8, 0.9), ("k0", 0.8, 0.9), ("k0", 0.95, 0.1), ("k1", 0.8, 0.7), ("k1", 0.8, 0.2), ("k1", 0.8, 0.2), ("k1", 0.8, 0.2)])
    rows = A.episodes(a, keys).orderBy("tick").collect()
    assert rows[0]["total_bits"] == rows[1]["total_bits"] < rows[2]["total_bits"] == rows[3]["total_bits"]
    assert rows[3]["episode"] == 1 and rows[-1]["episode"] == 2 and rows[-1]["smoothed_top"] == "k1" and rows[-1]["raw_total_bits"] > rows[-1]["total_bits"]
    assert [r["tick"] for r in A.rising_edges(a).orderBy("tick").collect()] == [0, 3]
    first = A.smoothed(a, keys).filter("tick = 0 and activity = 'k0'").first()
    assert first["smoothed"] == pytest.approx(0.32)
    scored = A.score(A.model_state(a.select("iface", "tick", F.lit("t").alias("text"), F.lit(None).cast("string").alias("previous"))), lambda b: b.assign(n=b["state"].str.len())[["iface", "n"]], "iface string, n long")
    assert scored.count() == 7


def test_catalog(spark):
    good = spark.createDataFrame([("Web  browsing", "a  b"), ("idle", "x")], "name string, shape string")
    assert {(r["key"], r["name"], r["shape"]) for r in E.catalog(good).collect()} == {("web_browsing", "Web browsing", "a b"), ("idle", "idle", "x")}
    for bad in ([("a", "x"), ("A ", "y")], [("a", "")]):
        with pytest.raises(ValueError):
            E.catalog(spark.createDataFrame(bad, "name string, shape string"))


def test_orientation_sticks(spark):
    rows = [("v", 0, "c", "10.0.0.1", 1, "8.8.8.8", 2, 1, 0), ("v", 1, "c", "8.8.8.8", 2, "10.0.0.1", 1, 0, 0), ("v", 2, "d", "10.0.0.1", 1, "10.0.0.2", 1, 0, 0)]
    df = spark.createDataFrame(rows, "iface string, arrival_seq long, conv_key string, src_ip string, src_port int, dst_ip string, dst_port int, src2dst_syn_packets int, dst2src_syn_packets int")
    no = F.lit(False)
    got = S.local_is_src(df, no, no, net.is_private_v4(F.col("src_ip")), net.is_private_v4(F.col("dst_ip"))).orderBy("arrival_seq").collect()
    assert [r["local_is_src"] for r in got] == [True, False, True]
