"""All measures of a stream, tick by tick, against the batch measures."""

import pytest
from pyspark.sql import functions as F

from shapeflow.operators import measures as M
from shapeflow.operators import segments as S
from shapeflow.sources import derived
from shapeflow.streaming import ticks

SF = "/root/testdata/sf0.001"
#: A segment far behind all others moves the watermark past them.
LAST = 10**9


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def streamed(spark, tmp_path, segs, files=2, **options):
    """Segments dealt over files in the order of time, one file a micro-batch; all rows that come out."""
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    last = segs.orderBy(F.desc("last_ms")).limit(1).withColumns({"iface": F.lit("end"), "first_ms": F.lit(LAST).cast("long"), "last_ms": F.lit(LAST).cast("long")})
    later = last.withColumns({"first_ms": F.lit(2 * LAST).cast("long"), "last_ms": F.lit(2 * LAST).cast("long")})
    edges = segs.approxQuantile("last_ms", [k / files for k in range(1, files)], 0.01)
    part = sum((F.col("last_ms") > e).cast("int") for e in edges) if edges else F.lit(0)
    for k in range(files):
        segs.filter(part == k).coalesce(1).write.mode("append").parquet(source)
    last.coalesce(1).write.mode("append").parquet(source)
    later.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(segs.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    query = ticks.stream_measures(stream, **options).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    return {(r["iface"], r["tick_end"]): r for r in spark.read.parquet(out).filter("iface <> 'end'").collect()}


def compare(got, batch):
    names = batch[0].asDict().keys()
    assert set(names) == set(next(iter(got.values())).asDict())
    for b in batch:
        g = got[b["iface"], b["tick_end"]]
        for c in names:
            assert g[c] == pytest.approx(b[c], abs=1e-9) if not isinstance(b[c], list) else g[c] == b[c], (c, b["iface"], b["tick_end"], g[c], b[c])


def test_stream_equals_batch_in_every_column(spark, tmp_path):
    segs = S.segments(derived.packets(spark, SF)).filter("last_ms < 50000").persist()
    compare(streamed(spark, tmp_path, segs), M.measures(segs).collect())


def test_silent_ticks(spark, tmp_path):
    """Links with pauses of many windows: every tick of the pause comes out, once, and says that nothing was there."""
    segs = S.segments(derived.sparse_packets(spark, SF)).filter("(last_ms < 40000 AND iface <> 'vif1') OR last_ms BETWEEN 100000 AND 160000 OR (last_ms > 400000 AND last_ms < 430000 AND iface = 'vif2')").persist()
    batch = M.measures(segs).collect()
    got = streamed(spark, tmp_path, segs, 3, patience=600)
    compare(got, batch)
    known = {(b["iface"], b["tick_end"]) for b in batch}
    assert sum(b["flows"] == 0 for b in batch) > 40
    behind = [r for k, r in got.items() if k not in known]  # behind a link's last segment, until it falls asleep
    last = {i: max(t for j, t in known if j == i) for i in {i for i, _ in known}}
    assert behind and all(r["flows"] == 0 and r["longest_gap_ms"] == 10_000 and last[r["iface"]] < r["tick_end"] <= last[r["iface"]] + 600 * 2_000 for r in behind)
    for i in last:
        own = sorted(t for j, t in got if j == i)
        assert own == list(range(own[0], own[-1] + 1, 2_000)) and own[-1] == last[i] + 600 * 2_000
