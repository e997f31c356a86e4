"""Row numbers within groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.session import one_task_each, store


def numbered_within(rows: DataFrame, group: str, order: str, name: str, ranges: int | None = None, columns: tuple[str | Column, ...] = ("*",)) -> DataFrame:
    """``rows`` with ``name``, the place from 1 of each row in its group by ``order``.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks;
    each range numbers its own rows and adds how many the group has in the ranges before,
    a table of one row for each range and group. Equal values of ``order`` share a range. ``ranges``: how many at most; then
    each is a task's share, and what a range begins with is broadcast. ``columns``: what is kept of the rows, computed once, behind their exchange.
    """
    dealt = (ranges,) if ranges else ()
    parts = store(rows.repartitionByRange(*dealt, group, order).select(*columns, F.spark_partition_id().alias("_range")), "ranges")
    counts = parts.groupBy(group, "_range").agg(F.count("*").alias("_own"))
    counts = counts.repartition(ranges, group) if ranges else counts
    before = counts.select(group, "_range", F.coalesce(F.sum("_own").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(order))
    if not ranges:
        return parts.withColumn("_at", inside).join(before, [group, "_range"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")
    # a range goes on with one group at most: no more rows than ranges
    before = before.filter("_before > 0").select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_before")
    met = one_task_each(parts, "_range").withColumn("_at", inside).join(F.broadcast(before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return met.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_range", "_before", "_at", "_g", "_r")
