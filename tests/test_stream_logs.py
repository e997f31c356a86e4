"""Packet logs and memory of streams, however they are cut into micro-batches, against batch results."""

import pytest
from pyspark.sql import functions as F

from shapeflow.operators import packets as P
from shapeflow.sources import derived
from shapeflow.streaming import flows, logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_files(spark, rows, path, edges):
    """Rows in the order of time, a file for each stretch between the edges, and two rows far behind that move the watermark."""
    for low, high in zip([0, *edges], [*edges, 10**8]):
        rows.filter((F.col("t_ms") >= low) & (F.col("t_ms") < high)).coalesce(1).write.mode("append").parquet(path)
    last = rows.limit(1).withColumn("iface", F.lit("end"))
    for t in (10**9, 2 * 10**9):
        last.withColumn("t_ms", F.lit(t).cast("long")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("step,edges", [(10_000, [31_000]), (2_000, [17_500])])
def test_logs_equal_batch(spark, tmp_path, step, edges):
    rows = derived.sparse_packets(spark, SF).withColumn("t_ms", F.expr("t_ms div 20")).filter("t_ms < 90000 AND t_ms NOT BETWEEN 40000 AND 55000").persist()
    want = {(r["iface"], r["tick_end"]): tuple(r) for r in P.packet_log(rows, 700, step_ms=step).collect()}
    query = logs.stream_packet_logs(in_files(spark, rows, str(tmp_path / "source"), edges), str(tmp_path / "logs"), str(tmp_path / "check"), 700, step_ms=step)
    query.awaitTermination(200)
    assert query.exception() is None
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "logs")).drop("batch").filter("iface <> 'end'").collect()]
    assert len(got) == len(want) > 10 and {r[:2]: r for r in got} == want and len({r[3] for r in got}) > 1


def test_endpoints_are_met_alike_at_any_speed(spark, tmp_path):
    rows = derived.sparse_packets(spark, SF).filter("t_ms < 600000").withColumn("endpoint", F.concat("endpoint", F.expr("t_ms div 1000 % 37"))).persist()
    want, last = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r["t_ms"]):
        k = (r["iface"], r["endpoint"])
        if k not in last or r["t_ms"] - last[k] > 50_000:
            want.add((*k, r["t_ms"]))
        last[k] = max(r["t_ms"], last.get(k, 0))
    assert len(want) > len(last) > 50
    for name, edges in (("slow", [100_000, 250_000, 260_000, 400_000]), ("fast", [])):
        stream = in_files(spark, rows, str(tmp_path / name), edges)
        query = flows.met_endpoints(stream, 50_000).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-check")).format("parquet").option("path", str(tmp_path / f"{name}-out")).trigger(availableNow=True).start()
        query.awaitTermination(100)
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).filter("iface <> 'end'").collect()} == want, name
