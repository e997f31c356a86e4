"""All window measures over a stream of segments, a row for every tick, silent ones too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructType

from shapeflow.operators.measures import BIN_MS, BINS, LAG_MS, STEP_MS, WINDOW_MS, segment_scalars
from shapeflow.operators.segments import FORGET_MS

TICK = ["iface", "w"]
#: What a window needs of a segment.
SEGMENT = (
    "iface string, key string, endpoint string, first_ms long, last_ms long, protocol int, up_packets long, down_packets long, up_bytes long, down_bytes long, mean_ps double, stddev_ps double, mean_piat_ms double, "
    "up_mean_piat_ms double, up_stddev_piat_ms double, down_mean_piat_ms double, down_stddev_piat_ms double, syn int, tiny double, large double, pairs int, changes int, ts timestamp"
)


def ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key and one micro-batch in event order."""
    return pd.concat(list(batches)).sort_values(["last_ms", "first_ms"], kind="stable", ignore_index=True)


class FirstContact(StatefulProcessor):
    """Marks the first segment of an endpoint on a link.

    With ``keep_ms`` an endpoint that was silent for longer, in event time, is met for the first time again: an event-time
    timer drops it once no row still to come could know it. Without, it is known as long as the stream has state.
    """

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.known.get()[0] if self.known.exists() else None
        if last is not None and self.keep_ms is not None:
            self.handle.deleteTimer(last + self.keep_ms + 1)
        own, fresh = ordered(rows), []
        for at in own["last_ms"].tolist():
            fresh.append(int(last is None or self.keep_ms is not None and at - last > self.keep_ms))
            last = at if last is None else max(at, last)
        self.known.update((last,))
        if self.keep_ms is not None:
            self.handle.registerTimer(last + self.keep_ms + 1)
        yield own.assign(new_endpoint=fresh)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


class FlowMemory(StatefulProcessor):
    """Gives each segment the time at which its flow was first seen since it was last forgotten.

    Forgetting follows event time alone: an event-time timer drops a flow once the watermark is FORGET_MS behind the
    flow's last segment, when no row still to come could belong to it, so a replay at any speed gives the same rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "first long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = self.flow.get() if self.flow.exists() else (None, None)
        if last is not None:
            self.handle.deleteTimer(last + FORGET_MS + 1)
        own, seen = ordered(rows), []
        for a, b in zip(own["first_ms"].tolist(), own["last_ms"].tolist()):
            if last is None or b - last > FORGET_MS:
                first = a
            last = b if last is None else max(b, last)
            seen.append(first)
        self.flow.update((first, last))
        self.handle.registerTimer(last + FORGET_MS + 1)
        yield own.assign(first_seen_ms=seen)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.flow.clear()
        return iter(())

    def close(self) -> None:
        pass


class EveryTick(StatefulProcessor):
    """Puts silent ticks between and behind a link's ticks.

    A timer stands at the tick after the last one that came out; when the watermark passes it and no row has come,
    the link was silent. A link falls asleep ``patience`` ticks behind its last segment; it wakes with the next one,
    and all ticks between come out then.
    """

    def __init__(self, columns: list[str], silent: dict, patience: int) -> None:
        self.columns, self.silent, self.patience = columns, silent, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ticks", "last long, spoken long")

    def empty(self, link: str, ticks: range) -> pd.DataFrame:
        return pd.DataFrame([{"iface": link, "tick_end": t, **self.silent} for t in ticks], columns=self.columns)

    def due(self, tick: int) -> int:
        """When the windows of a tick are closed: their rows come before."""
        return tick + LAG_MS + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("tick_end", ignore_index=True)
        last = None
        if self.state.exists():
            last, _ = self.state.get()
            self.handle.deleteTimer(self.due(last + STEP_MS))
        for at, tick in enumerate(own["tick_end"].tolist()):
            if last is not None and tick > last + STEP_MS:
                yield self.empty(key[0], range(last + STEP_MS, tick, STEP_MS))
            yield own[at : at + 1][self.columns]
            last = tick if last is None else max(last, tick)
        self.state.update((last, last))
        self.handle.registerTimer(self.due(last + STEP_MS))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, spoken = self.state.get()
        now = timerValues.getCurrentWatermarkInMs()
        passed = max(last, min((now - LAG_MS - 1) // STEP_MS * STEP_MS, spoken + self.patience * STEP_MS))
        self.state.update((passed, spoken))
        if passed < spoken + self.patience * STEP_MS:
            self.handle.registerTimer(self.due(passed + STEP_MS))
        if passed > last:
            yield self.empty(key[0], range(last + STEP_MS, passed + STEP_MS, STEP_MS))

    def close(self) -> None:
        pass


def share(of: Column, whole: Column) -> Column:
    return F.coalesce(of / F.nullif(whole, F.lit(0)), F.lit(0.0))


def in_windows(segments: DataFrame) -> DataFrame:
    """Each segment in each window it belongs to, with what the window clips: its bins and its packets inside."""
    w = segments.withColumn("w", F.window("ts", f"{WINDOW_MS + LAG_MS + 1} milliseconds", f"{STEP_MS} milliseconds")).withColumn("start_ms", F.unix_millis("w.start"))
    w = w.withColumn("a", F.greatest("first_ms", "start_ms")).withColumn("b", F.least(F.greatest("last_ms", "a"), F.col("start_ms") + WINDOW_MS))
    inside = F.when(F.col("last_ms") > F.col("first_ms"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("b") - F.col("a")) / (F.col("last_ms") - F.col("first_ms"))))).otherwise(1.0)
    place = lambda c: f"cast(least({BINS - 1}, greatest(0, ({c} - start_ms) div {BIN_MS})) AS int)"
    return w.withColumn("i0", F.expr(place("a"))).withColumn("i1", F.expr(place("b"))).withColumn("f", inside / (F.col("i1") - F.col("i0") + 1))


def flow_level(w: DataFrame) -> DataFrame:
    """One row for each flow of a window: what the measures of flows need, and sums; the bins are an array as state, one sum for each."""
    n = F.col("up_packets") + F.col("down_packets")
    ways = [(F.col(f"{x}_packets"), F.col(f"{x}_mean_piat_ms"), F.col(f"{x}_stddev_piat_ms")) for x in ("up", "down")]
    of_bin = lambda k, c: F.sum(F.when(F.lit(k).between(F.col("i0"), F.col("i1")), F.col(c) * F.col("f")).otherwise(0.0))
    return w.withColumn("packets", n).groupBy(*TICK, "key").agg(
        (F.max("last_ms") - F.min(F.least("first_ms", "first_seen_ms"))).alias("life"),
        ((F.sum("syn") > 0) | (F.min(F.least("first_ms", "first_seen_ms")) >= F.min("start_ms"))).cast("int").alias("new"),
        F.collect_set("endpoint").alias("ends"), F.sum("new_endpoint").alias("new_endpoints"), *(F.sum(c).alias(c) for c in ("up_bytes", "down_bytes", "up_packets", "down_packets")),
        F.sum(F.col("mean_ps") * n).alias("ps"), F.sum((F.col("stddev_ps") * F.col("stddev_ps") + F.col("mean_ps") * F.col("mean_ps")) * n).alias("ps2"),
        F.sum(F.col("tiny") * n).alias("tiny"), F.sum(F.col("large") * n).alias("large"), F.sum(F.when(n > 1, F.col("mean_piat_ms") * (n - 1)).otherwise(0.0)).alias("piat"), F.sum(F.when(n > 1, n - 1).otherwise(0)).alias("gaps"),
        F.sum(sum(F.when((k > 1) & (mean > 0), sd / mean * (k - 1)).otherwise(0.0) for k, mean, sd in ways)).alias("cv"), F.sum(sum(F.when((k > 1) & (mean > 0), k - 1).otherwise(0) for k, mean, _ in ways)).alias("cv_n"),
        *(F.sum(F.when(F.col("protocol") == p, n).otherwise(0)).alias(f"p{p}") for p in (6, 17)), F.sum("changes").alias("changes"), F.sum("pairs").alias("pairs"),
        *(of_bin(k, c).alias(f"{c}{k}") for c in ("packets", "up_packets") for k in range(BINS)))


def tick_level(flows: DataFrame) -> DataFrame:
    """One row for each window from the rows of its flows."""
    sums = ("up_bytes", "down_bytes", "up_packets", "down_packets", "new_endpoints", "ps", "ps2", "tiny", "large", "piat", "gaps", "cv", "cv_n", "p6", "p17", "changes", "pairs")
    bytes_ = F.col("up_bytes") + F.col("down_bytes")
    return flows.groupBy(*TICK).agg(
        F.count("*").alias("flows"), F.avg("life").alias("mean_lifetime_ms"), F.avg("new").alias("new_flow_frac"), share(F.max(bytes_).cast("double"), F.sum(bytes_)).alias("top_flow_share"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ends")))).cast("long").alias("endpoints"), *(F.sum(c).alias(c) for c in sums),
        F.array(*(F.sum(f"packets{k}") for k in range(BINS))).alias("bins"), F.array(*(F.sum(f"up_packets{k}") for k in range(BINS))).alias("ups"))


def finished(t: DataFrame) -> DataFrame:
    """The measures from a window's sums and bins, and the window, which carries the watermark on. Runs of bins are runs of
    one digit in a text of BINS digits."""
    n, mean = F.col("up_packets") + F.col("down_packets"), share(F.col("ps"), F.col("up_packets") + F.col("down_packets"))
    bits = F.concat_ws("", F.transform("bins", lambda x: F.when(F.round(x, 9) >= 0.5, "1").otherwise("0")))
    lengths = lambda digit, c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(f"({digit}+)"), F.lit(1)), F.length))
    t = t.withColumn("bits", bits).withColumn("on", lengths("1", F.col("bits"))).withColumn("off", lengths("0", F.col("bits"))).withColumn("inner", lengths("0", F.regexp_replace("bits", "^0+|0+$", "")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def spread(c: str) -> Column:
        """Deviation over mean of an array's values; null where the mean is not above zero."""
        m = total(c) / F.size(c)
        return F.when(m > 0, F.sqrt(F.aggregate(F.transform(c, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / F.size(c)) / m)

    middle = lambda c: (F.get(c, F.expr(f"(size({c}) - 1) div 2")) + F.get(c, F.expr(f"size({c}) div 2"))) / 2
    start = F.unix_millis("w.start")
    starts = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: (F.substring("bits", k + 1, F.lit(1)) == "1") & ((k == 0) | (F.substring("bits", k, F.lit(1)) == "0")))
    return t.select(
        "w", "iface", (start + WINDOW_MS).alias("tick_end"), *(F.col(c) for c in ("flows", "endpoints", "new_endpoints", "up_bytes", "down_bytes", "up_packets", "down_packets")),
        F.size("on").cast("long").alias("bursts"), (F.coalesce(F.array_max("on"), F.lit(0)) * BIN_MS).cast("long").alias("longest_burst_ms"), mean.alias("mean_ps"),
        F.when(mean > 0, F.sqrt(F.greatest(share(F.col("ps2"), n) - mean * mean, F.lit(0.0))) / mean).otherwise(0.0).alias("ps_cv"),
        share(F.col("tiny"), n).alias("tiny_frac"), share(F.col("large"), n).alias("large_frac"), share(F.col("piat"), F.col("gaps")).alias("mean_piat_ms"), share(F.col("cv"), F.col("cv_n")).alias("piat_cv"),
        share(F.col("p6").cast("double"), n).alias("tcp_frac"), share(F.col("p17").cast("double"), n).alias("udp_frac"), share(F.col("changes").cast("double"), F.col("pairs")).alias("alternation"),
        (F.coalesce(F.aggregate("on", F.lit(0), lambda a, x: a + x), F.lit(0)) / BINS).alias("active_bin_frac"), F.coalesce(middle("on") * BIN_MS, F.lit(0.0)).alias("typical_burst_ms"), F.coalesce(spread("ups"), F.lit(0.0)).alias("up_bin_cv"),
        "mean_lifetime_ms", "new_flow_frac", "top_flow_share", (F.coalesce(F.array_max("off"), F.lit(0)) * BIN_MS).cast("long").alias("longest_gap_ms"),
        F.size(F.filter("off", lambda x: x * BIN_MS >= 1000)).cast("long").alias("gaps_over_1s"), F.when(F.size("inner") >= 2, F.coalesce(spread("inner"), F.lit(0.0))).otherwise(-1.0).alias("burst_gap_cv"),
        F.transform(starts, lambda k: start + k * BIN_MS).alias("burst_starts_ms"), ((F.col("up_bytes") + F.col("down_bytes")) / (WINDOW_MS / 1000)).alias("bytes_per_s"), (n / (WINDOW_MS / 1000)).alias("packets_per_s"),
    )


#: What a window without segments has where that is not zero.
SILENT = {"longest_gap_ms": WINDOW_MS, "gaps_over_1s": 1, "burst_gap_cv": -1.0, "burst_starts_ms": []}


def stream_measures(segments: DataFrame, late: str = "15 seconds", patience: int = 43_200) -> DataFrame:
    """The rows of ``measures.measures`` from a stream of segments, in append mode; a tick comes out when the watermark has passed it.

    Four stateful steps, each keyed as finely as it can be: endpoints of a link (first contacts), flows of a link (when
    first seen), flows of a window, windows; only the last, which puts in silent ticks, is keyed by link, and has one
    row a tick. A link that is silent for ``patience`` ticks (a day) stops ticking until it speaks again. Segments later than
    ``late`` are left out, as no window could take them whole.
    """
    s = segment_scalars(segments).withColumn("ts", F.timestamp_millis("last_ms")).withWatermark("ts", late)
    plain = StructType.fromDDL(SEGMENT)
    met = StructType([*plain, *StructType().add("new_endpoint", IntegerType())])
    seen = StructType([*met, *StructType().add("first_seen_ms", LongType())])
    s = s.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in plain))
    s = s.groupBy("iface", "endpoint").transformWithStateInPandas(FirstContact(), met, "append", "eventTime", eventTimeColumnName="ts")
    s = s.groupBy("iface", "key").transformWithStateInPandas(FlowMemory(), seen, "append", "eventTime", eventTimeColumnName="ts")
    ticks = finished(tick_level(flow_level(in_windows(s))))
    out = StructType([f for f in ticks.schema if f.name != "w"])
    silent = {f.name: SILENT.get(f.name, 0.0 if f.dataType.typeName() == "double" else 0) for f in out if f.name not in ("iface", "tick_end")}
    return ticks.groupBy("iface").transformWithStateInPandas(EveryTick(out.names, silent, patience), out, "append", "eventTime")
