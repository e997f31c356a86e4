"""Scans over ranges against windows, with one key that is spread over tasks."""

import pytest
from pyspark.sql import functions as F

from shapeflow.operators import answers as A
from shapeflow.operators import scans
from shapeflow.operators import segments as S
from shapeflow.operators.ranks import numbered_within
from shapeflow.session import one_task_each
from shapeflow.sources import derived

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Without it, adaptive execution makes one range of tables this small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def one_flow(spark):
    return derived.packets(spark, SF).withColumns({"iface": F.lit("vif0"), "flow": F.lit("hot"), "t_ms": F.expr("t_ms * 7 % 400000 + (t_ms * 7 % 400000 div 50000) * 5000")})


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_key_is_spread(spark):
    ranged = scans.in_ranges(one_flow(spark), ["iface", "flow"], ["t_ms", "seq"])
    sizes = [r["count"] for r in ranged.groupBy(scans.RANGE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


@pytest.mark.parametrize("left_out", [False, True])
def test_running_values(spark, left_out):
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id < 400 THEN 'hot' ELSE 'b' END AS g", "id * 37 % 101 AS at", "CASE WHEN id % 7 < 4 THEN NULL ELSE id % 13 END AS v")
    values = {k: (k, F.col("v"), left_out) for k in ("sum", "max", "last", "first")}
    plain = scans.running(rows, ["g"], ["at", "id"], **values)
    same(plain, scans.running(scans.in_ranges(rows, ["g"], ["at", "id"]), ["g"], ["at", "id"], **values).drop(scans.RANGE))
    by = {}
    for r in sorted(plain.collect(), key=lambda r: (str(r["g"]), r["at"], r["id"])):
        own = by.setdefault(r["g"], [])
        seen = own if left_out else [*own, r["v"]]
        known = [x for x in seen if x is not None]
        assert (r["sum"], r["max"], r["last"], r["first"]) == ((sum(known), max(known), known[-1], known[0]) if known else (None,) * 4)
        own.append(r["v"])


def test_islands_of_one_flow(spark):
    rows = one_flow(spark)
    plain = S.cut_segments(rows).select("seq", "t_ms", "island", "cut")
    assert plain.agg(F.max("island")).first()[0] > 3
    same(plain, S.cut_segments(rows, True).select("seq", "t_ms", "island", "cut"))


def test_first_seen_of_one_flow(spark):
    segs = spark.range(600).selectExpr("'vif0' AS iface", "'hot' AS key", "id * 900 + (id div 100) * 60000 AS first_ms").withColumn("last_ms", F.col("first_ms") + F.col("first_ms") % 1900)
    plain = S.first_seen(segs)
    assert plain.select("first_seen_ms").distinct().count() == 6
    same(plain, S.first_seen(segs, True))


def test_orientation_of_one_conversation(spark):
    r = spark.range(800).selectExpr("'vif0' AS iface", "'c' AS conv_key", "id AS arrival_seq", "if(id % 3 = 0, 'a', 'b') AS src_ip", "if(id % 3 = 0, 'b', 'a') AS dst_ip", "1 AS src_port", "1 AS dst_port", "if(id % 97 = 5, 1, 0) AS src2dst_syn_packets", "if(id % 89 = 3, 1, 0) AS dst2src_syn_packets")
    no = F.lit(False)
    plain = S.local_is_src(r, no, no, F.col("src_ip") == "a", F.col("dst_ip") == "a")
    assert 0 < plain.filter("local_is_src").count() < 800
    same(plain, S.local_is_src(r, no, no, F.col("src_ip") == "a", F.col("dst_ip") == "a", True))


def test_episodes_of_one_link(spark):
    keys = [a.replace(" ", "_") for a in derived.ACTIVITIES]
    rows = derived.answers(spark, SF).withColumn("iface", F.lit("vif0"))
    rounded = lambda df: df.select("tick", "smoothed_top", "episode", *(F.round(c, 6).alias(c) for c in ("bits", "gain", "total_bits", "raw_total_bits")))
    same(rounded(A.episodes(rows, keys)), rounded(A.episodes(rows, keys, True)))


def test_tasks_grow_with_rows(spark, monkeypatch):
    from shapeflow import session
    from shapeflow.operators import packets as P

    rows = derived.packets(spark, SF)
    assert P.at_ticks(rows).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    assert P.at_ticks(rows).rdd.getNumPartitions() == -(-5 * rows.count() // 1_000)


def test_a_link_is_smoothed_in_blocks(spark, monkeypatch):
    keys = ["k0", "k1"]
    rows = spark.range(700).selectExpr("'vif0' AS iface", "id AS tick", "map('k0', id * 7 % 11 / 11, 'k1', id * 5 % 13 / 13) AS probabilities")
    monkeypatch.setattr(A, "BLOCK", 128)
    blocks = A._blocks(rows, keys)
    assert blocks.groupBy(F.spark_partition_id()).count().count() > 1
    mean = {"k0": 0.0, "k1": 0.0}
    found = {(r["tick"], r["activity"]): r["smoothed"] for r in A.smoothed(rows, keys).collect()}
    assert len(found) == 1400
    for tick in range(700):
        for k, p in (("k0", tick * 7 % 11 / 11), ("k1", tick * 5 % 13 / 13)):
            mean[k] += 0.4 * (p - mean[k])
            assert abs(found[tick, k] - mean[k]) < 1e-12
    top = A.top_smoothed(rows, keys, 1).collect()
    assert len(top) == 700 and all(r["rank"] == 1 and r["smoothed"] == max(found[r["tick"], k] for k in keys) for r in top)


def test_a_range_is_a_tasks_share(spark):
    """Ranges dealt by their hashes fell together, so the largest task grew with their number."""
    rows = spark.range(2400).selectExpr("if(id < 2200, 'hot', if(id < 2300, 'b', null)) AS g", "id * 7 % 2400 AS at")
    numbered = numbered_within(rows, "g", "at", "nth", 24).withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in numbered.groupBy("task").count().collect()) < 250
    places = {g: sorted(r["nth"] for r in numbered.filter(F.col("g").eqNullSafe(F.lit(g))).collect()) for g in ("hot", "b", None)}
    assert places == {g: list(range(1, n + 1)) for g, n in (("hot", 2200), ("b", 100), (None, 100))}
    ranged = one_task_each(scans.in_ranges(rows, ["g"], ["at"], 24), scans.RANGE).withColumn("task", F.spark_partition_id())
    assert ranged.groupBy("task").agg(F.countDistinct(scans.RANGE).alias("n")).filter("n > 1").isEmpty()


def test_many_groups_stay_dealt(spark, monkeypatch):
    """What groups come to in each range met in a few tasks, merged by compressed bytes, so the largest task grew with the groups."""
    rows = spark.range(4000).selectExpr("'vif0' AS g", "id div 13 AS part", "id AS at", "id * 7919 % 1000 AS v")
    ranged = scans.in_ranges(rows, ["g"], ["at"], 16)
    kept, plain = [], scans.F.broadcast
    monkeypatch.setattr(scans.F, "broadcast", lambda df: kept.append(df) or plain(df))
    most = scans.running(ranged, ["g", "part"], ["at"], most=("max", F.col("v"), True))
    same(scans.running(rows, ["g", "part"], ["at"], most=("max", F.col("v"), True)), most.drop(scans.RANGE))
    assert len(kept) == 1 and 0 < kept[0].count() < 16 and kept[0].rdd.getNumPartitions() == 16
