"""Sinks: labelled samples, per-tick lines, event logs, evaluation results, streamed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_samples(rows: DataFrame, path: str) -> None:
    """Append JSON lines of the rows that carry a label."""
    rows.filter(F.coalesce("label", F.lit("")) != "").write.mode("append").json(path)


def write_ticks(ticks: DataFrame, path: str, drop: tuple[str, ...] = ("text", "confidences", "intensities")) -> None:
    """One JSON line a tick, without histories and texts."""
    ticks.drop(*drop).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def write_events(events: DataFrame, path: str) -> None:
    events.select(F.format_string("%d %s %s %s %.2f", "tick", "iface", "kind", "activity", "probability").alias("value")).write.mode("append").text(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def stream_snapshots(states: DataFrame, path: str, checkpoint: str):
    """The latest row of each link, of all micro-batches so far: each writes a whole version to ``path/batch=<id>``.

    A version is the one before, merged with the batch's rows by link and tick, so a link that is silent keeps its row,
    and a batch that is played again writes the same version again. A version stays until the next one is followed by a
    third. ``read_snapshot`` reads the last that is complete. Ties of a tick go to the batch that came later.
    """
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_batch", F.lit(1))
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).json(f"{path}/batch={number - 1}").withColumn("_batch", F.lit(0)))
        latest = rows.groupBy("iface").agg(F.max_by(F.struct(*batch.columns), F.struct("tick", "_batch")).alias("s")).select("s.*")
        latest.write.mode("overwrite").json(f"{path}/batch={number}")
        if number > 1:
            files, where = _files(spark, f"{path}/batch={number - 2}")
            files.delete(where, True)

    return states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete version that ``stream_snapshots`` has written."""
    files, where = _files(spark, path)
    versions = [str(x.getPath()) for x in files.listStatus(where) if x.isDirectory() and files.exists(_files(spark, f"{x.getPath()}/_SUCCESS")[1])]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(max(versions, key=lambda x: int(x.rpartition("batch=")[2])))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
