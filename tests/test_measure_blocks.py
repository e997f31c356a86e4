"""Window measures: what is exchanged, and what the driver holds."""

from pyspark.sql import functions as F

from shapeflow.operators import measures as M
from shapeflow.operators import segments as S
from shapeflow.sources import derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_multiply_segments_behind_the_exchange(spark):
    prepared = M.store(M.prepare(S.segments(derived.sparse_packets(spark, SF))), "p")
    m = M.members(prepared)
    text = plan(m.groupBy(*M.DEALT).count())
    assert text.count("Exchange hashpartitioning") == 1 and text.index("Generate") < text.index("Exchange hashpartitioning")  # the top comes first
    plain = prepared.select("iface", "key", "last_ms", F.explode(F.expr(M._ticks())).alias("tick_end"))
    own = m.select("iface", "key", "last_ms", "tick_end")
    assert own.exceptAll(plain).isEmpty() and plain.exceptAll(own).isEmpty()


def test_no_part_of_the_measures_goes_through_the_driver(spark):
    m = M.measures(S.segments(derived.sparse_packets(spark, SF)))
    m.collect()
    assert "Broadcast" not in plan(m)
