"""Streaming forms of the window statistics and session memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS, STEP_MS, LAG_MS = 10_000, 2_000, 2_250


def event_time(packets: DataFrame, column: str = "t_ms") -> DataFrame:
    return packets.withColumn("ts", F.timestamp_millis(F.col(column)))


def hopping_counts(segments: DataFrame, late: str = "15 seconds") -> DataFrame:
    """Per link and tick: segments, bytes and packets, segments counted up to LAG_MS behind the tick's end. Append mode:
    a tick comes out once the watermark passes it."""
    first = f"cast(ceil((last_ms - {LAG_MS}) / {STEP_MS}) AS bigint) * {STEP_MS}"
    last = f"cast(floor((last_ms + {WINDOW_MS}) / {STEP_MS}) AS bigint) * {STEP_MS}"
    ticks = segments.withColumn("tick", F.explode(F.expr(f"sequence({first}, {last}, {STEP_MS}L)"))).withColumn("tick_end", F.timestamp_millis("tick"))
    return ticks.withWatermark("tick_end", late).groupBy("iface", "tick_end").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def hopping_measures(segments: DataFrame, late: str = "15 seconds") -> DataFrame:
    """Per link and tick, the measures of hopping windows that are sums over segments or sets of their ids, as the batch
    measures define them. A window's ids are kept until the watermark passes its tick. Append mode."""
    first = f"cast(ceil((last_ms - {LAG_MS}) / {STEP_MS}) AS bigint) * {STEP_MS}"
    last = f"cast(floor((last_ms + {WINDOW_MS}) / {STEP_MS}) AS bigint) * {STEP_MS}"
    ticks = segments.withColumn("tick", F.explode(F.expr(f"sequence({first}, {last}, {STEP_MS}L)"))).withColumn("tick_end", F.timestamp_millis("tick"))
    n = F.col("up_packets") + F.col("down_packets")
    gaps = F.when(n > 1, n - 1).otherwise(0)
    share = lambda of, whole: F.coalesce(of / F.nullif(whole, F.lit(0)), F.lit(0.0))
    sums = ticks.withWatermark("tick_end", late).groupBy("iface", "tick_end").agg(
        F.size(F.collect_set("key")).alias("flows"), F.size(F.collect_set("endpoint")).alias("endpoints"), *(F.sum(c).alias(c) for c in ("up_bytes", "down_bytes", "up_packets", "down_packets")),
        F.sum(F.col("mean_ps") * n).alias("_ps"), F.sum((F.col("stddev_ps") * F.col("stddev_ps") + F.col("mean_ps") * F.col("mean_ps")) * n).alias("_ps2"), F.sum(F.col("mean_piat_ms") * gaps).alias("_piat"), F.sum(gaps).alias("_gaps"),
        *(F.sum(F.when(F.col("protocol") == k, n).otherwise(0)).alias(f"_{k}") for k in (6, 17)))
    total, mean = F.col("up_packets") + F.col("down_packets"), share(F.col("_ps"), F.col("up_packets") + F.col("down_packets"))
    return sums.select(
        "iface", "tick_end", "flows", "endpoints", "up_bytes", "down_bytes", "up_packets", "down_packets", mean.alias("mean_ps"),
        F.when(mean > 0, F.sqrt(F.greatest(share(F.col("_ps2"), total) - mean * mean, F.lit(0.0))) / mean).otherwise(0.0).alias("ps_cv"), share(F.col("_piat"), F.col("_gaps")).alias("mean_piat_ms"),
        share(F.col("_6"), total).alias("tcp_frac"), share(F.col("_17"), total).alias("udp_frac"),
        ((F.col("up_bytes") + F.col("down_bytes")) / (WINDOW_MS / 1000)).alias("bytes_per_s"), (total / (WINDOW_MS / 1000)).alias("packets_per_s"))


def tumbling_batches(packets: DataFrame, length: str = "2 seconds", late: str = "300 milliseconds") -> DataFrame:
    """Per link and batch: packets and bytes; a batch is drained ``late`` behind its end."""
    return event_time(packets).withWatermark("ts", late).groupBy("iface", F.window("ts", length)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select("iface", F.col("window.end").alias("batch_end"), "packets", "bytes")


def idle_sessions(packets: DataFrame, gap: str = "2 seconds", late: str = "2 seconds") -> DataFrame:
    """Per link and flow: runs of packets without a pause of ``gap``."""
    s = event_time(packets).withWatermark("ts", late).groupBy("iface", "flow", F.session_window("ts", gap)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return s.select("iface", "flow", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets", "bytes")


def first_contacts(packets: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each endpoint's first packet on a link, remembered for the watermark's length."""
    return event_time(packets).withWatermark("ts", late).dropDuplicatesWithinWatermark(["iface", "endpoint"]).select("iface", "endpoint", "ts")


def met_endpoints(packets: DataFrame, keep_ms: int = 3_600_000, late: str = "15 seconds") -> DataFrame:
    """(iface, endpoint, last_ms) of each packet with which an endpoint is met, for the first time or after ``keep_ms`` of
    silence. Memory is pruned by event time alone, so a replay at any speed meets the same."""
    from shapeflow.streaming.ticks import FirstContact

    rows = event_time(packets).withWatermark("ts", late).select("iface", "endpoint", F.col("t_ms").alias("first_ms"), F.col("t_ms").alias("last_ms"), "ts")
    out = "iface string, endpoint string, first_ms long, last_ms long, ts timestamp, new_endpoint int"
    met = rows.groupBy("iface", "endpoint").transformWithStateInPandas(FirstContact(keep_ms), out, "append", "eventTime")
    return met.filter("new_endpoint = 1").select("iface", "endpoint", "last_ms")


def without_noted(segments: DataFrame, noted: DataFrame, memory: str, hold: str = "1500 milliseconds") -> DataFrame:
    """Segments whose flow is not noted from ``memory`` before to ``hold`` behind; a segment waits until its note can have come.

    An outer join with time bounds, as streams have no anti join.
    """
    u = event_time(segments, "last_ms").withWatermark("ts", hold).alias("u")
    d = event_time(noted, "last_ms").withWatermark("ts", hold).select(F.col("key").alias("d_key"), F.col("ts").alias("d_ts")).alias("d")
    on = F.expr(f"key = d_key AND d_ts >= ts - INTERVAL {memory} AND d_ts <= ts + INTERVAL {hold}")
    return u.join(d, on, "left_outer").filter(F.col("d_key").isNull()).drop("d_key", "d_ts")


def drop_shared(upstream: DataFrame, downstream: DataFrame) -> DataFrame:
    """Upstream segments without a downstream copy, which is remembered for 300 seconds."""
    return without_noted(upstream, downstream, "300 seconds")


def drop_own(segments: DataFrame, own: DataFrame) -> DataFrame:
    """Segments of none of the profiler's own flows, which are remembered for 600 seconds."""
    return without_noted(segments, own, "600 seconds")


class LinkState(StatefulProcessor):
    """Smoothed answers, episodes, edges and the last HISTORY confidences and intensities of one link, tick by tick; a new link is a new key."""

    ALPHA, EVENT_AT, HISTORY = 0.4, 0.6, 60
    OUT = (
        "iface string, tick long, smoothed_top string, bits double, total_bits double, raw_total_bits double, episode long, events string, "
        "confidences array<double>, intensities array<double>"
    )

    def __init__(self, options: int) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("link", "top string, smoothed string, edges string, episode long, most double, total double, raw double")
        self.history = handle.getListState("history", "confidence double, intensity double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import json
        import math

        top, smoothed, edges, episode, most, total, raw = self.state.get() if self.state.exists() else (None, "{}", "{}", 0, 0.0, 0.0, 0.0)
        smoothed, edges, out = json.loads(smoothed), json.loads(edges), []
        past = [tuple(x) for x in self.history.get()] if self.history.exists() else []
        for r in sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: r["tick"]):
            p, kinds = json.loads(r["probabilities"]), json.loads(r["nouls"])
            for k in {*smoothed, *p}:
                smoothed[k] = smoothed.get(k, 0.0) + self.ALPHA * (p.get(k, 0.0) - smoothed.get(k, 0.0))
            best = min(smoothed, key=lambda k: (-round(smoothed[k], 9), k))
            whole = sum(x for x in p.values() if x > 0)
            bits = max(0.0, math.log2(self.options) + sum(x / whole * math.log2(x / whole) for x in p.values() if x > 0))
            raw += bits
            if best != top:
                top, episode, most, total = best, episode + 1, bits, total + bits
            elif bits > most:
                total, most = total + bits - most, bits
            events = sorted(k for k, x in kinds.items() if x >= self.EVENT_AT and not edges.get(k, False))
            edges |= {k: x >= self.EVENT_AT for k, x in kinds.items()}
            past = [*past, (float(r["confidence"]), float(r["intensity"]))][-self.HISTORY :]
            out.append((key[0], r["tick"], top, bits, total, raw, episode, ",".join(events), *map(list, zip(*past))))
        self.history.put(past)
        self.state.update((top, json.dumps(smoothed), json.dumps(edges), episode, most, total, raw))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def close(self) -> None:
        pass


def link_states(answers: DataFrame, options: int) -> DataFrame:
    """Running state of every link over an answer stream (iface, tick, confidence, intensity, probabilities and nouls as maps)."""
    rows = answers.select("iface", "tick", "confidence", "intensity", F.to_json("probabilities").alias("probabilities"), F.to_json("nouls").alias("nouls"))
    return rows.groupBy("iface").transformWithStateInPandas(LinkState(options), LinkState.OUT, "append", "none")


class FirstSeen(StatefulProcessor):
    """When each flow was first seen since it was last forgotten; forgetting is by event time, so late rows do not revive it.
    The state of a flow of which no row has come for ``keep_ms`` by the clock is dropped."""

    OUT = "iface string, key string, last_ms long, first_seen_ms long"

    def __init__(self, forget_ms: int = 20_000, keep_ms: int = 3_600_000) -> None:
        self.forget_ms, self.keep_ms = forget_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("flow", "first long, last long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = self.state.get() if self.state.exists() else (None, None)
        out = []
        for r in sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: (r["last_ms"], r["first_ms"])):
            if last is None or r["last_ms"] - last > self.forget_ms:
                first = int(r["first_ms"])
            last = max(int(r["last_ms"]), last if last is not None else int(r["last_ms"]))
            out.append((key[0], key[1], int(r["last_ms"]), first))
        self.state.update((first, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def close(self) -> None:
        pass


def first_seen(segments: DataFrame) -> DataFrame:
    return segments.select("iface", "key", "first_ms", "last_ms").groupBy("iface", "key").transformWithStateInPandas(FirstSeen(), FirstSeen.OUT, "append", "processingTime")
