"""Flow assembly: packets to segments, and what a session remembers of flows and endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators.scans import RANGE, in_ranges, running
from shapeflow.session import tasks

IDLE_MS = ACTIVE_MS = 2_000
SAMPLE = 10
#: A flow unseen for longer than this is forgotten.
FORGET_MS = 20_000


def cut_segments(packets: DataFrame, spread: bool = False) -> DataFrame:
    """island and cut of each packet: a new island after IDLE_MS of silence of its flow, cut every ACTIVE_MS from the island's start.

    With ``spread`` a flow of any length is dealt over many tasks.
    """
    flow, order = ["iface", "flow"], ["t_ms", "seq"]
    p = running(in_ranges(packets, flow, order, tasks(packets)) if spread else packets, flow, order, _before=("last", F.col("t_ms"), True))
    p = p.withColumn("_new", F.when(F.col("t_ms") - F.col("_before") < IDLE_MS, 0).otherwise(1))
    p = running(p, flow, order, island=("sum", F.col("_new"), False), _start=("last", F.when(F.col("_new") == 1, F.col("t_ms")), False))
    return p.withColumn("cut", F.expr(f"(t_ms - _start) div {ACTIVE_MS}")).drop("_before", "_new", "_start", RANGE)


def segments(packets: DataFrame, spread: bool = False) -> DataFrame:
    """One row for each segment: times, counts, sizes, gaps (both ways and each way), and the first SAMPLE packets' directions, sizes and gaps.

    Deviations are sample deviations, 0 below two values. ``syn`` is 1 for a flow's first segment, as the log text has no flags.
    """
    key = ["iface", "flow", "island", "cut"]
    by = Window.partitionBy(*key).orderBy("t_ms", "seq")
    p = cut_segments(packets, spread).repartition(tasks(packets), *key)
    p = p.withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(by)).withColumn("own_gap", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy(*key, "out").orderBy("t_ms", "seq"))).withColumn("nth", F.row_number().over(by))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    up, down = F.col("out"), ~F.col("out")
    first = F.when(F.col("nth") <= SAMPLE, F.struct("nth", F.when(up, 0).otherwise(1).alias("d"), F.col("length").alias("l"), F.coalesce("gap", F.lit(0)).alias("g")))
    s = p.groupBy(*key).agg(
        F.min_by("endpoint", "nth").alias("endpoint"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.min_by("proto", "nth").alias("protocol"),
        F.count_if(up).alias("up_packets"), F.count_if(down).alias("down_packets"),
        F.coalesce(F.sum(F.when(up, F.col("length"))), F.lit(0)).alias("up_bytes"), F.coalesce(F.sum(F.when(down, F.col("length"))), F.lit(0)).alias("down_bytes"),
        F.avg("length").alias("mean_ps"), zero(F.stddev_samp("length")).alias("stddev_ps"), F.min("length").alias("min_ps"), F.max("length").alias("max_ps"),
        zero(F.avg("gap")).alias("mean_piat_ms"), zero(F.stddev_samp("gap")).alias("stddev_piat_ms"), zero(F.max("gap").cast("double")).alias("max_piat_ms"),
        zero(F.avg(F.when(up, F.col("own_gap")))).alias("up_mean_piat_ms"), zero(F.stddev_samp(F.when(up, F.col("own_gap")))).alias("up_stddev_piat_ms"),
        zero(F.avg(F.when(down, F.col("own_gap")))).alias("down_mean_piat_ms"), zero(F.stddev_samp(F.when(down, F.col("own_gap")))).alias("down_stddev_piat_ms"),
        F.array_sort(F.collect_list(first)).alias("_s"),
    )
    return s.select(
        "iface", F.col("flow").alias("key"), "endpoint", "island", "cut", "first_ms", "last_ms", "protocol", "up_packets", "down_packets", "up_bytes", "down_bytes", "mean_ps", "stddev_ps", "min_ps", "max_ps",
        "mean_piat_ms", "stddev_piat_ms", "max_piat_ms", "up_mean_piat_ms", "up_stddev_piat_ms", "down_mean_piat_ms", "down_stddev_piat_ms",
        F.when((F.col("island") == 1) & (F.col("cut") == 0), 1).otherwise(0).alias("syn"),
        F.transform("_s", lambda x: x["d"]).alias("splt_direction"), F.transform("_s", lambda x: x["l"]).alias("splt_ps"), F.transform("_s", lambda x: x["g"]).alias("splt_piat_ms"),
    )


def first_contacts(segs: DataFrame) -> DataFrame:
    """(iface, endpoint, last_ms) of each endpoint's first segment in the session."""
    return segs.groupBy("iface", "endpoint").agg(F.min(F.struct("last_ms", "first_ms")).alias("f")).select("iface", "endpoint", F.col("f.last_ms").alias("last_ms"))


def first_seen(segs: DataFrame, spread: bool = False) -> DataFrame:
    """``segs`` with first_seen_ms: when the flow was first seen, since it was last forgotten. ``spread``: as in ``cut_segments``."""
    flow, order = ["iface", "key"], ["last_ms", "first_ms"]
    s = running(in_ranges(segs, flow, order) if spread else segs, flow, order, _before=("max", F.col("last_ms"), True))
    fresh = F.col("_before").isNull() | (F.col("last_ms") - F.col("_before") > FORGET_MS)
    return running(s, flow, order, first_seen_ms=("last", F.when(fresh, F.col("first_ms")), False)).drop("_before", RANGE)


def local_is_src(records: DataFrame, local_src: Column, local_dst: Column, private_src: Column, private_dst: Column, spread: bool = False) -> DataFrame:
    """Sticky orientation of conversations (iface, conv_key; order by arrival_seq): ``local_is_src``.

    A local address on one side decides, else a SYN from one side only, else what the
    conversation's rows before decided, else the one private side, else the source. ``spread``: as in ``cut_segments``.
    """
    src, dst = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    fresh, back = F.col("src2dst_syn_packets") > 0, F.col("dst2src_syn_packets") > 0
    side = lambda c: F.when(c, src).otherwise(dst)
    decisive = F.when(local_src != local_dst, side(local_src)).when(fresh != back, side(fresh))
    guess = F.when(private_src != private_dst, side(private_src)).otherwise(src)
    r = records.withColumn("_d", decisive).withColumn("_g", guess).withColumn("_s", src)
    talk, order = ["iface", "conv_key"], ["arrival_seq"]
    r = running(in_ranges(r, talk, order) if spread else r, talk, order, _last=("last", F.col("_d"), True), _first=("first", F.col("_g"), False))
    return r.withColumn("local_is_src", F.coalesce("_d", "_last", "_first") == F.col("_s")).drop("_d", "_g", "_s", "_last", "_first", RANGE)


def is_heartbeat() -> Column:
    return (F.col("protocol") == 17) & (F.col("dst_port") == 65530) & (F.col("dst_ip") == "239.192.255.254")


def is_probe(local_src: Column) -> Column:
    """Flows that are no activity: ICMP; a refused remote handshake of small packets; an unanswered lone datagram from outside."""
    pick = lambda a, b: F.when(local_src, F.col(a)).otherwise(F.col(b))
    own_syn, their_syn = pick("src2dst_syn_packets", "dst2src_syn_packets"), pick("dst2src_syn_packets", "src2dst_syn_packets")
    own, n, size = pick("src2dst_packets", "dst2src_packets"), F.col("bidirectional_packets"), F.col("bidirectional_bytes")
    return (
        F.when(F.col("protocol").isin(1, 58), True)
        .when(F.col("protocol") == 6, (their_syn > 0) & (own_syn == 0) & (F.col("bidirectional_rst_packets") > 0) & (n > 0) & (size < 80 * n))
        .when(n > 4, False)
        .when(F.col("protocol") == 17, ~local_src & (own == 0))
        .otherwise(False)
    )


def drop_own(segs: DataFrame, own_flows: DataFrame, own_endpoints: DataFrame) -> DataFrame:
    """Segments of neither the own flows (key) nor the own endpoints (endpoint)."""
    return segs.join(own_flows.select("key").distinct(), "key", "left_anti").join(own_endpoints.select("endpoint").distinct(), "endpoint", "left_anti")


def drop_shared(upstream: DataFrame, downstream: DataFrame, memory_ms: int = 300_000, hold_ms: int = 1_500) -> DataFrame:
    """Upstream segments without a downstream copy of the flow noted from ``memory_ms`` before to ``hold_ms`` behind.

    The join's key holds the time cell too, so a flow that never ends is dealt over many tasks.
    """
    span = memory_ms + hold_ms
    v = downstream.select(F.col("key").alias("_k"), F.col("last_ms").alias("_t")).distinct().withColumn("_c", F.expr(f"_t div {span}"))
    u = upstream.withColumn("_cell", F.explode(F.expr(f"array_distinct(array((last_ms - {memory_ms}) div {span}, (last_ms + {hold_ms}) div {span}))")))
    seen = u.join(v, (F.col("key") == F.col("_k")) & (F.col("_cell") == F.col("_c")) & F.col("_t").between(F.col("last_ms") - memory_ms, F.col("last_ms") + hold_ms), "left_semi")
    cols = ["iface", "key", "first_ms", "last_ms"]
    return upstream.join(seen.select(*cols).distinct(), cols, "left_anti")


def rebase(records: DataFrame, start_ms: int, speed: float) -> DataFrame:
    """A capture's clock moved to ``start_ms`` and run ``speed`` times as fast; the origin is each link's first packet."""
    origin = records.groupBy("iface").agg(F.min("first_ms").alias("_origin"))
    r = records.join(origin, "iface")
    last = (F.lit(start_ms) + (F.col("last_ms") - F.col("_origin")) / F.lit(speed)).cast("long")
    return r.withColumn("new_last_ms", last).withColumn("new_first_ms", F.col("new_last_ms") - ((F.col("last_ms") - F.col("first_ms")) / F.lit(speed)).cast("long")).drop("_origin")
