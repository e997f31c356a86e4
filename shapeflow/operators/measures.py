"""Statistics of hopping windows over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators.scans import in_ranges, running
from shapeflow.operators.segments import first_contacts, first_seen
from shapeflow.session import store, tasks

WINDOW_MS, STEP_MS, LAG_MS, BIN_MS = 10_000, 2_000, 2_250, 250
BINS = WINDOW_MS // BIN_MS
TINY, LARGE, ACK = 100, 1000, 64
#: Starts nearer than this are one burst; how long bursts count.
SAME_MS, MINUTE_MS = 500, 60_000
CELL = ["iface", "tick_end"]
#: Ticks of a link that are dealt as one, and the key of a cell among them.
BLOCK_TICKS = 64
DEALT = ["iface", "_block", "tick_end"]
#: What the measures read of a prepared segment.
MEASURED = ("iface", "key", "endpoint", "protocol", "first_ms", "last_ms", "first_seen_ms", "packets", "up_packets", "down_packets", "up_bytes", "down_bytes", "mean_ps", "stddev_ps", "mean_piat_ms",
            "up_mean_piat_ms", "up_stddev_piat_ms", "down_mean_piat_ms", "down_stddev_piat_ms", "syn", "tiny", "large", "pairs", "changes")


FIRST_TICK, LAST_TICK = f"cast(ceil((last_ms - {LAG_MS}) / {STEP_MS}) AS bigint)", f"cast(floor((last_ms + {WINDOW_MS}) / {STEP_MS}) AS bigint)"


def _ticks() -> str:
    return f"sequence({FIRST_TICK} * {STEP_MS}, {LAST_TICK} * {STEP_MS}, {STEP_MS}L)"


def prepare(segs: DataFrame) -> DataFrame:
    return first_seen(segment_scalars(segs))


def segment_scalars(segs: DataFrame) -> DataFrame:
    """Scalars of each segment that no window changes, so that the arrays stay behind before rows are multiplied."""
    sample = F.filter("splt_ps", lambda x: x > 0)
    share = lambda test, mean: F.when(F.size(sample) > 0, F.size(F.filter(sample, test)) / F.size(sample)).otherwise(F.when(mean, 1.0).otherwise(0.0))
    turns = F.filter(F.zip_with("splt_direction", "splt_ps", lambda d, p: F.when(d.isin(0, 1) & (p > ACK), d)), lambda d: d.isNotNull())
    s = segs.withColumn("packets", F.col("up_packets") + F.col("down_packets")).withColumn("_d", turns)
    s = s.withColumn("tiny", share(lambda p: p <= TINY, F.col("mean_ps") <= TINY)).withColumn("large", share(lambda p: p >= LARGE, F.col("mean_ps") >= LARGE))
    s = s.withColumn("pairs", F.greatest(F.size("_d") - 1, F.lit(0))).withColumn("changes", F.when(F.size("_d") > 1, F.size(F.filter(F.zip_with(F.slice("_d", 2, 10), F.expr("slice(_d, 1, size(_d) - 1)"), lambda a, b: a != b), lambda x: x))).otherwise(0))
    return s.drop("_d", "splt_direction", "splt_ps", "splt_piat_ms")


def _dealt(prepared: DataFrame, count: int | None = None) -> DataFrame:
    """Each segment once for each block of ticks it belongs to (``_number``), dealt by link and block, which ``_block`` stands for: equal ones share a task."""
    block = lambda tick: f"cast(floor({tick} / {BLOCK_TICKS}) AS bigint)"
    rows = prepared.withColumn("_number", F.explode(F.expr(f"sequence({block(FIRST_TICK)}, {block(LAST_TICK)})")))
    return rows.withColumn("_block", F.xxhash64("iface", "_number")).repartition(tasks(prepared, WINDOW_MS // STEP_MS + 1, count), "_block")


def _in_windows(dealt: DataFrame) -> DataFrame:
    own = f"sequence(greatest({FIRST_TICK}, _number * {BLOCK_TICKS}) * {STEP_MS}, least({LAST_TICK}, _number * {BLOCK_TICKS} + {BLOCK_TICKS - 1}) * {STEP_MS}, {STEP_MS}L)"
    return dealt.withColumn("tick_end", F.explode(F.expr(own))).drop("_number").withColumn("start_ms", F.col("tick_end") - WINDOW_MS)


def members(prepared: DataFrame) -> DataFrame:
    """Each segment in each window it belongs to: last seen in the window, or up to LAG_MS behind its end.

    What is exchanged is each segment once for each block of ticks it belongs to, seldom two; windows multiply
    it in the block's task, where all that is grouped by DEALT stays.
    """
    return _in_windows(_dealt(prepared))


def spine(prepared: DataFrame) -> DataFrame:
    """Every tick of a link from its first window to its last."""
    ends = prepared.groupBy("iface").agg(F.min(F.expr(FIRST_TICK)).alias("a"), F.max(F.expr(LAST_TICK)).alias("b"))
    return ends.select("iface", F.explode(F.sequence("a", "b")).alias("tick")).select("iface", (F.col("tick") * STEP_MS).alias("tick_end"))


def flow_measures(m: DataFrame) -> DataFrame:
    keys = m.groupBy(*DEALT, "start_ms", "key").agg(
        (F.max("last_ms") - F.min(F.least("first_ms", "first_seen_ms"))).alias("life"), F.sum(F.col("up_bytes") + F.col("down_bytes")).alias("bytes"),
        ((F.sum("syn") > 0) | (F.min(F.least("first_ms", "first_seen_ms")) >= F.col("start_ms"))).alias("new"))
    return keys.groupBy(*DEALT).agg(
        F.count("*").alias("flows"), F.avg("life").alias("mean_lifetime_ms"), F.avg(F.col("new").cast("int")).alias("new_flow_frac"),
        F.coalesce(F.max("bytes") / F.nullif(F.sum("bytes"), F.lit(0)), F.lit(0.0)).alias("top_flow_share"))


def sum_measures(m: DataFrame) -> DataFrame:
    cell = Window.partitionBy(*DEALT)
    n = F.col("packets")
    m = m.withColumn("_mean", F.sum(F.col("mean_ps") * n).over(cell) / F.sum(n).over(cell))
    each = lambda x, y: F.coalesce(F.sum(x) / F.nullif(F.sum(y), F.lit(0)), F.lit(0.0))
    ways = [(F.col(f"{w}_packets"), F.col(f"{w}_mean_piat_ms"), F.col(f"{w}_stddev_piat_ms")) for w in ("up", "down")]
    cv_n = sum(F.when((k > 1) & (mean > 0), k - 1).otherwise(0) for k, mean, _ in ways)
    cv = sum(F.when((k > 1) & (mean > 0), sd / mean * (k - 1)).otherwise(0.0) for k, mean, sd in ways)
    return m.groupBy(*DEALT).agg(
        F.count_distinct("endpoint").alias("endpoints"), *(F.sum(c).alias(c) for c in ("up_bytes", "down_bytes", "up_packets", "down_packets")),
        each(F.col("mean_ps") * n, n).alias("mean_ps"), each((F.col("stddev_ps") * F.col("stddev_ps") + (F.col("mean_ps") - F.col("_mean")) * (F.col("mean_ps") - F.col("_mean"))) * n, n).alias("_var"),
        each(F.col("tiny") * n, n).alias("tiny_frac"), each(F.col("large") * n, n).alias("large_frac"),
        each(F.when(n > 1, F.col("mean_piat_ms") * (n - 1)).otherwise(0.0), F.when(n > 1, n - 1).otherwise(0)).alias("mean_piat_ms"), each(cv, cv_n).alias("piat_cv"),
        each(F.when(F.col("protocol") == 6, n).otherwise(0), n).alias("tcp_frac"), each(F.when(F.col("protocol") == 17, n).otherwise(0), n).alias("udp_frac"),
        each("changes", "pairs").alias("alternation"),
    ).withColumn("ps_cv", F.when(F.col("mean_ps") > 0, F.sqrt(F.greatest("_var", F.lit(0.0))) / F.col("mean_ps")).otherwise(0.0)).drop("_var")


def bin_table(m: DataFrame) -> DataFrame:
    """(iface, tick_end, bin, packets, up): each segment's packets inside the window, spread evenly over its bins; all bins of the cell."""
    a = F.greatest("first_ms", "start_ms")
    m = m.withColumn("a", a).withColumn("b", F.least(F.greatest("last_ms", "a"), "tick_end"))
    frac = F.when(F.col("last_ms") > F.col("first_ms"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("b") - F.col("a")) / (F.col("last_ms") - F.col("first_ms"))))).otherwise(1.0)
    place = lambda c: f"cast(least({BINS - 1}, greatest(0, ({c} - start_ms) div {BIN_MS})) AS int)"
    m = m.withColumn("f", frac).withColumn("i0", F.expr(place("a"))).withColumn("i1", F.expr(place("b")))
    spans = m.groupBy(*DEALT, "i0", "i1").agg(F.sum(F.col("packets") * F.col("f")).alias("p"), F.sum(F.col("up_packets") * F.col("f")).alias("u"))
    none = F.array(F.struct(F.lit(0).alias("i0"), F.lit(BINS - 1).alias("i1"), F.lit(0.0).alias("p"), F.lit(0.0).alias("u")))  # makes all bins of the cell
    spans = spans.groupBy(*DEALT).agg(F.collect_list(F.struct("i0", "i1", "p", "u")).alias("own")).select(*DEALT, F.inline(F.concat("own", none)))
    each = lambda c: F.sum(F.col(c) / (F.col("i1") - F.col("i0") + 1))
    return spans.withColumn("bin", F.explode(F.sequence("i0", "i1"))).groupBy(*DEALT, "bin").agg(each("p").alias("packets"), each("u").alias("up"))


def burst_measures(bins: DataFrame) -> DataFrame:
    by, cell = Window.partitionBy(*DEALT).orderBy("bin"), Window.partitionBy(*DEALT)
    g = bins.withColumn("active", F.round("packets", 9) >= 0.5).withColumn("up_bin_cv", F.when(F.avg("up").over(cell) > 0, F.stddev_pop("up").over(cell) / F.avg("up").over(cell)).otherwise(0.0))
    runs = (
        g.withColumn("new", F.when(F.lag("active").over(by) == F.col("active"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
        .groupBy(*DEALT, "run").agg(F.first("active").alias("active"), F.first("up_bin_cv").alias("up_bin_cv"), F.count("*").alias("n"), F.min("bin").alias("first"), F.max("bin").alias("last"))
    )
    on, off = F.col("active"), ~F.col("active")
    inner = F.when(off & (F.col("first") > 0) & (F.col("last") < BINS - 1), F.col("n"))
    return runs.groupBy(*DEALT).agg(
        F.first("up_bin_cv").alias("up_bin_cv"),
        (F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)) / BINS).alias("active_bin_frac"), F.count_if(on).alias("bursts"),
        F.coalesce(F.max(F.when(on, F.col("n"))) * BIN_MS, F.lit(0)).alias("longest_burst_ms"), F.coalesce(F.median(F.when(on, F.col("n"))) * BIN_MS, F.lit(0.0)).alias("typical_burst_ms"),
        F.coalesce(F.max(F.when(off, F.col("n"))) * BIN_MS, F.lit(0)).alias("longest_gap_ms"), F.count_if(off & (F.col("n") * BIN_MS >= 1000)).alias("gaps_over_1s"),
        F.when(F.count(inner) >= 2, F.stddev_pop(inner) / F.avg(inner)).otherwise(-1.0).alias("burst_gap_cv"),
        F.array_sort(F.collect_list(F.when(on, F.col("tick_end") - WINDOW_MS + F.col("first") * BIN_MS))).alias("burst_starts_ms"),
    )


def new_endpoints(segs: DataFrame) -> DataFrame:
    """(iface, tick_end, new_endpoints): endpoints first met in the window."""
    return first_contacts(segs).withColumn("tick_end", F.explode(F.expr(_ticks()))).groupBy(*CELL).agg(F.count("*").alias("new_endpoints"))


def measures(segs: DataFrame, count: int | None = None) -> DataFrame:
    """One row for each tick of each link, silent ones too.

    The prepared segments, without what no part reads, are written once. Where the caller knows a ``count`` that the segments don't exceed they are
    not written, as they need not be counted. All parts share one exchange: its rows leave through a generator that no filter or pruning passes, so its readers are alike.
    """
    prepared = prepare(segs).select(*MEASURED)
    dealt = _dealt(prepared if count is not None else store(prepared, "prepared-segments"), count)
    dealt = dealt.select("_block", F.inline(F.array(F.struct("_number", *MEASURED))))
    m = _in_windows(dealt)
    joined = spine(dealt)
    for part in (flow_measures(m), sum_measures(m), burst_measures(bin_table(m)), new_endpoints(dealt)):
        joined = joined.join(part.drop("_block").hint("merge"), CELL, "left")  # as long as the log: never through the driver
    zero = lambda c, t="long": F.coalesce(c, F.lit(0).cast(t)).alias(c)
    whole = ("flows", "endpoints", "new_endpoints", "up_bytes", "down_bytes", "up_packets", "down_packets", "bursts", "longest_burst_ms")
    real = ("mean_ps", "ps_cv", "tiny_frac", "large_frac", "mean_piat_ms", "piat_cv", "tcp_frac", "udp_frac", "alternation", "active_bin_frac", "typical_burst_ms", "up_bin_cv", "mean_lifetime_ms", "new_flow_frac", "top_flow_share")
    return joined.select(
        *CELL, *(zero(c) for c in whole), *(zero(c, "double") for c in real), F.coalesce("longest_gap_ms", F.lit(WINDOW_MS).cast("long")).alias("longest_gap_ms"), F.coalesce("gaps_over_1s", F.lit(1).cast("long")).alias("gaps_over_1s"),
        F.coalesce("burst_gap_cv", F.lit(-1.0)).alias("burst_gap_cv"), F.coalesce("burst_starts_ms", F.array().cast("array<bigint>")).alias("burst_starts_ms"),
        ((F.coalesce("up_bytes", F.lit(0)) + F.coalesce("down_bytes", F.lit(0))) / (WINDOW_MS / 1000)).alias("bytes_per_s"), ((F.coalesce("up_packets", F.lit(0)) + F.coalesce("down_packets", F.lit(0))) / (WINDOW_MS / 1000)).alias("packets_per_s"),
    )


def minute_rhythm(m: DataFrame, spread: bool = False) -> DataFrame:
    """(iface, tick_end, long_gap_cv, long_bursts): bursts of the last minute, each counted once.

    A start within SAME_MS of one already noted is the same burst, so what is noted depends on the order of ticks; but
    only among starts that hang together, each within SAME_MS of the next. Starts lie on the grid of bins and a burst has a silent
    bin before it, but at a window's edge, so such a group has a few starts, however long the log is. Each is folded by itself in
    the order in which its starts came; then a noted start counts in the ticks of the minute behind it. The work is
    dealt by link and group, then by link and tick; with ``spread`` the groups of one link are found by ranges, too.
    """
    ticks = store(m.select(*CELL, "burst_starts_ms"), "burst-starts")
    first = ticks.select(*CELL, F.explode("burst_starts_ms").alias("start")).groupBy("iface", "start").agg(F.min("tick_end").alias("tick"))
    link, order = ["iface"], ["start"]
    s = running(in_ranges(first, link, order) if spread else first, link, order, _before=("last", F.col("start"), True))
    s = running(s.withColumn("_new", F.when(F.col("start") - F.col("_before") < SAME_MS, 0).otherwise(1)), link, order, _group=("sum", F.col("_new"), False))
    groups = s.groupBy("iface", "_group").agg(F.array_sort(F.collect_list(F.struct("tick", "start"))).alias("own"))
    none = F.array().cast("array<struct<tick:bigint,start:bigint>>")
    noted = F.aggregate("own", none, lambda a, x: F.when(F.exists(a, lambda y: F.abs(y["start"] - x["start"]) < SAME_MS), a).otherwise(F.concat(a, F.array(x))))
    upto = F.floor((F.col("x.start") + MINUTE_MS) / STEP_MS).cast("long") * STEP_MS
    counted = groups.select("iface", F.explode(noted).alias("x")).select("iface", F.col("x.start").alias("start"), F.explode(F.sequence("x.tick", upto, F.lit(STEP_MS).cast("long"))).alias("tick_end"))
    own = counted.groupBy(*CELL).agg(F.array_sort(F.collect_list("start")).alias("own"))  # a minute of starts
    gaps = F.zip_with(F.slice("own", 2, F.greatest(F.size("own"), F.lit(1))), F.slice("own", 1, F.greatest(F.size("own") - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    own = own.withColumn("_gaps", gaps).withColumn("_mean", total(F.col("_gaps")) / F.greatest(F.size("_gaps"), F.lit(1)))
    cv = F.sqrt(total(F.transform("_gaps", lambda g: (g - F.col("_mean")) * (g - F.col("_mean")))) / F.size("_gaps")) / F.col("_mean")
    own = own.select(*CELL, F.when((F.size("_gaps") >= 2) & (F.col("_mean") > 0), cv).otherwise(-1.0).alias("long_gap_cv"), F.size("own").cast("long").alias("long_bursts"))
    return ticks.select(*CELL).join(own, CELL, "left").select(*CELL, F.coalesce("long_gap_cv", F.lit(-1.0)).alias("long_gap_cv"), F.coalesce("long_bursts", F.lit(0).cast("long")).alias("long_bursts"))


def shapes(m: DataFrame, rhythm: DataFrame | None = None) -> DataFrame:
    """The words of each tick and its text; the trend compares with the link's tick before."""
    from shapeflow.functions.levels import prose, shape_columns

    m = m.join(rhythm, CELL, "left") if rhythm is not None else m.withColumns({"long_gap_cv": F.lit(-1.0), "long_bursts": F.lit(0)})
    by = Window.partitionBy("iface").orderBy("tick_end")
    m = m.withColumns({f"prev_{c}": F.coalesce(F.lag(c).over(by), F.lit(0)).cast("double") for c in ("bytes_per_s", "flows", "packets_per_s")})
    words = m.select(*CELL, *(F.expr(q).alias(k) for k, q in shape_columns().items()))
    return words.withColumn("text", prose()).withColumn("tokens", F.greatest(F.lit(1), F.bround(F.length("text") / 4).cast("int")))
