"""Streamed snapshots and link histories."""

import pytest
from pyspark.sql import functions as F

from shapeflow.operators import answers as A
from shapeflow.sources import derived, sinks
from shapeflow.streaming import flows

SCHEMA = "iface string, tick long, note string"


def test_snapshots_keep_silent_links(spark, tmp_path):
    """Each file is a micro-batch; a link without a row in the last one is still there, and a replayed batch changes nothing."""
    source, path = str(tmp_path / "source"), str(tmp_path / "snapshot")
    batches = [[("a", 1, "x"), ("b", 1, "x"), ("a", 3, "x")], [("b", 2, "y"), ("a", 2, "late")], [("c", 9, "z")], [("b", 2, "again")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = sinks.stream_snapshots(stream, path, str(tmp_path / "check"))
        query.awaitTermination(60)
    want = {("a", 3, "x"), ("b", 2, "again"), ("c", 9, "z")}
    assert {tuple(r) for r in sinks.read_snapshot(spark, path, SCHEMA).collect()} == want
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the session ended before the batch was known to be done
    (tmp_path / "check" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    query = sinks.stream_snapshots(spark.readStream.schema(SCHEMA).parquet(source), path, str(tmp_path / "check"))
    query.awaitTermination(60)
    assert query.exception() is None and {tuple(r) for r in sinks.read_snapshot(spark, path, SCHEMA).collect()} == want
    assert len(list((tmp_path / "snapshot").glob("batch=*"))) == 2


def test_no_snapshot_yet(spark, tmp_path):
    (tmp_path / "snapshot").mkdir()
    assert sinks.read_snapshot(spark, str(tmp_path / "snapshot"), SCHEMA).count() == 0


def test_histories_of_links_equal_batch(spark, tmp_path):
    rows = derived.answers(spark, "/root/testdata/sf0.001").withColumn("confidence", F.col("tick") % 7 / 7).persist()
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    for low in (0, 400):
        rows.filter(F.col("tick").between(low, low + 399) if low == 0 else F.col("tick") >= 400).coalesce(1).write.mode("append").parquet(source)
        query = flows.link_states(spark.readStream.schema(rows.schema).parquet(source), 11).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(100)
    got = {(r["iface"], r["tick"]): r for r in spark.read.parquet(out).collect()}
    batch = A.histories(rows).collect()
    assert len(batch) == len(got) and max(len(r["confidences"]) for r in batch) == 60
    for b in batch:
        g = got[b["iface"], b["tick"]]
        assert g["confidences"] == pytest.approx(b["confidences"]) and g["intensities"] == pytest.approx(b["intensities"])
