"""Packet logs of a stream's closed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.operators.packets import STEP_MS, WINDOW_MS, windows_log
from shapeflow.streaming.flows import event_time

PACKET = ("seq", "t_ms", "out", "proto", "endpoint", "length", "label")


def closed_windows(packets: DataFrame, window_ms: int = WINDOW_MS, step_ms: int = STEP_MS, late: str = "300 milliseconds") -> DataFrame:
    """(iface, flow, tick_end, start_ms, own) of each flow in each window that the watermark has passed: its packets whole.

    A window [tick_end - window, tick_end) is drained ``late`` behind its end; all its flows come out in one micro-batch. State is
    kept by flow, so a busy link's window is spread over tasks; packets older than that leave it (30 s and more are never held).
    """
    windows = event_time(packets).withWatermark("ts", late).groupBy("iface", "flow", F.window("ts", f"{window_ms} milliseconds", f"{step_ms} milliseconds").alias("w"))
    end = F.unix_millis("w.end")
    return windows.agg(F.collect_list(F.struct(*PACKET)).alias("own")).select("iface", "flow", end.alias("tick_end"), (end - window_ms).alias("start_ms"), "own")


def stream_packet_logs(packets: DataFrame, path: str, checkpoint: str, budget: int = 12_000, window_ms: int = WINDOW_MS, step_ms: int = STEP_MS, late: str = "300 milliseconds"):
    """The texts of ``packet_log`` for every window of a stream of packets, tumbling where window and step agree.

    Each micro-batch hands its closed windows whole to the batch operator and writes what comes of them to
    ``path/batch=<id>``; a batch that is played again writes the same again.
    """
    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("iface", "flow", "tick_end", "start_ms", F.inline("own")).repartition("iface", "tick_end")
        windows_log(rows, budget).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_windows(packets, window_ms, step_ms, late).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
