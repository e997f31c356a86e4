"""Streams over the same rows give what the batch operators give."""

import json

import pytest
from pyspark.sql import functions as F

from shapeflow.operators import answers as A
from shapeflow.operators import segments as S
from shapeflow.sources import derived, sinks
from shapeflow.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def streamed(spark, tmp_path):
    """Rows written as Parquet, read as a stream, run to the end of what is there; returns the collected result."""
    def run(rows, build, mode="append", order=None):
        source, out = str(tmp_path / "source"), str(tmp_path / "out")
        (rows.orderBy(order) if order else rows).coalesce(1).write.parquet(source)
        query = build(spark.readStream.schema(rows.schema).parquet(source)).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(out)

    return run


def test_link_states_equal_batch(spark, streamed):
    rows = derived.answers(spark, SF)
    got = {(r["iface"], r["tick"]): r for r in streamed(rows, lambda s: flows.link_states(s, len(derived.ACTIVITIES))).collect()}
    keys = [a.replace(" ", "_") for a in derived.ACTIVITIES]
    batch = A.episodes(rows, keys).collect()
    assert len(batch) == len(got)
    for b in batch:
        g = got[b["iface"], b["tick"]]
        assert g["smoothed_top"] == b["smoothed_top"] and g["episode"] == b["episode"] and g["total_bits"] == pytest.approx(b["total_bits"]) and g["raw_total_bits"] == pytest.approx(b["raw_total_bits"])
    edges = {(r["iface"], r["tick"], r["kind"]) for r in A.rising_edges(rows).collect()}
    assert edges == {(i, t, k) for (i, t), r in got.items() for k in filter(None, r["events"].split(","))}


def test_first_seen_equals_batch(spark, streamed):
    segs = S.segments(derived.sparse_packets(spark, SF)).select("iface", "key", "first_ms", "last_ms").filter("iface = 'vif1'")
    got = sorted(map(tuple, streamed(segs, flows.first_seen).collect()))
    assert got == sorted(map(tuple, S.first_seen(segs).select("iface", "key", "last_ms", "first_seen_ms").collect()))


def test_closed_windows_equal_batch(spark, streamed):
    packets = derived.sparse_packets(spark, SF)
    got = streamed(packets, flows.tumbling_batches).collect()
    batch = {(r["iface"], r["b"]): (r["n"], r["bytes"]) for r in packets.groupBy("iface", F.expr("timestamp_millis((t_ms div 2000 + 1) * 2000)").alias("b")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()}
    assert got and all(batch[r["iface"], r["batch_end"]] == (r["packets"], r["bytes"]) for r in got)


def test_hopping_equals_batch(spark, streamed):
    from shapeflow.operators import measures as M

    segs = S.segments(derived.sparse_packets(spark, SF)).withColumn("packets", F.col("up_packets") + F.col("down_packets")).withColumn("bytes", F.col("up_bytes") + F.col("down_bytes")).select("iface", "key", "first_ms", "last_ms", "packets", "bytes")
    got = streamed(segs, flows.hopping_counts).collect()
    batch = {(r["iface"], r["t"]): (r["n"], r["bytes"]) for r in segs.withColumn("tick_end", F.explode(F.expr(M._ticks()))).groupBy("iface", F.timestamp_millis("tick_end").alias("t")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    assert got and all(batch[r["iface"], r["tick_end"]] == (r["segments"], r["bytes"]) for r in got)


def test_sessions_and_first_contacts(spark, streamed):
    packets = derived.sparse_packets(spark, SF).filter("flow = 'flow1'")
    sessions = streamed(packets, flows.idle_sessions).collect()
    islands = {(r["iface"], r["n"], r["a"]) for r in S.cut_segments(packets).groupBy("iface", "flow", "island").agg(F.count("*").alias("n"), F.timestamp_millis(F.min("t_ms")).alias("a")).collect()}
    assert sessions and all((r["iface"], r["packets"], r["start"]) in islands for r in sessions)


def test_first_contacts_equal_batch(spark, streamed):
    packets = derived.sparse_packets(spark, SF)
    got = {(r["iface"], r["endpoint"], r["ts"]) for r in streamed(packets, flows.first_contacts, order="t_ms").collect()}
    assert got == {(r["iface"], r["endpoint"], r["ts"]) for r in packets.groupBy("iface", "endpoint").agg(F.timestamp_millis(F.min("t_ms")).alias("ts")).collect()}


def test_hopping_measures_equal_batch(spark, streamed):
    from shapeflow.operators import measures as M

    segs = S.segments(derived.sparse_packets(spark, SF)).filter("iface = 'vif0'").selectExpr("* except (first_ms, last_ms)", "first_ms + 1000000 AS first_ms", "last_ms + 1000000 AS last_ms")  # a watermark starts at 0
    end = segs.agg(F.max("last_ms")).first()[0] + 100_000  # a row of another link, which closes all ticks before it
    closing = segs.limit(1).withColumns({"iface": F.lit("later"), "first_ms": F.lit(end), "last_ms": F.lit(end)})
    got = {(r["iface"], r["tick_end"]): r for r in streamed(segs.unionByName(closing), flows.hopping_measures).collect()}
    batch = M.measures(segs).filter("flows > 0").withColumn("tick_end", F.timestamp_millis("tick_end")).collect()
    assert set(got) == {(r["iface"], r["tick_end"]) for r in batch}
    for r in batch:
        own = got[r["iface"], r["tick_end"]].asDict()
        assert all(own[c] == pytest.approx(r[c], rel=1e-6, abs=1e-6) for c in own if c not in ("iface", "tick_end")), r


@pytest.mark.parametrize("drop, memory", [(flows.drop_shared, 300_000), (flows.drop_own, 600_000)])
def test_noted_flows_equal_batch(spark, tmp_path, drop, memory):
    segs = [("vif0", f"f{k % 7}", 1_000 * k * k) for k in range(60)]
    noted = [("x", f"f{k % 5}", 100_000 * k + 700) for k in range(0, 30, 3)]
    far = 10**8  # closes the join for all rows before it
    for name, rows in (("a", segs), ("b", noted)):
        spark.createDataFrame([*rows, ("end", name, far)], "iface string, key string, last_ms long").coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name: spark.readStream.schema("iface string, key string, last_ms long").parquet(str(tmp_path / name))
    query = drop(stream("a"), stream("b")).writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["key"], r["last_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["last_ms"] < far)
    assert got == sorted((k, t) for _, k, t in segs if not any(k == x and t - memory <= n <= t + 1_500 for _, x, n in noted))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "vif0", "ssh", 0.5), (2, "vif0", "", 0.1), (3, "vif1", None, 0.2)], "tick long, iface string, label string, p double")
    sinks.write_samples(rows, str(tmp_path / "s"))
    assert [r["label"] for r in spark.read.json(str(tmp_path / "s")).collect()] == ["ssh"]
    sinks.write_ticks(rows, str(tmp_path / "t"))
    assert sorted(json.loads(r["value"])["tick"] for r in spark.read.text(str(tmp_path / "t")).collect()) == [1, 2, 3]
    events = spark.createDataFrame([(1, "vif0", "automated", "ssh", 0.7)], "tick long, iface string, kind string, activity string, probability double")
    sinks.write_events(events, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()["value"] == "1 vif0 automated ssh 0.70"
    sinks.write_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
