"""Running values over groups of rows in an order, also for groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.session import numbers_of, one_task_each, store

RANGE = "_range"


def in_ranges(rows: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of (group, order) and written, with the number of each row's range. Rows alike in all of these share a range."""
    dealt = (ranges,) if ranges else ()
    return store(rows.repartitionByRange(*dealt, *group, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _over(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.first(v, ignorenulls=True)}[kind](value)


def _of_range(kind: str, value: Column, order: list[str]) -> Column:
    """The value of a whole range: the operation is associative, so ranges can be put together from theirs."""
    if kind in ("sum", "max"):
        return _over(kind, value)
    known = F.when(value.isNotNull(), F.struct(*order, value.alias("_v")))
    return (F.max(known) if kind == "last" else F.min(known))["_v"]


def _joined(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + inside, before, inside)
    if kind == "max":
        return F.greatest(before, inside)
    return F.coalesce(inside, before) if kind == "last" else F.coalesce(before, inside)


def running(rows: DataFrame, group: list[str], order: list[str], **values: tuple[str, Column, bool]) -> DataFrame:
    """``rows`` with running values of their group: name=(kind, value, whether the row itself is left out).

    kind: sum, max, last or first; nulls don't count. By a window over the group, or, where ``rows`` come from
    ``in_ranges`` by the group's columns, or some of them, and this order, by an associative scan: each range computes its own values, and begins with what its group's ranges
    before come to, a table of one row for each range that goes on with a group. The result is written then, so several scans one
    after another read their rows once each.
    """
    upto = lambda part, left_out: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if left_out else 0)
    if RANGE not in rows.columns:
        return rows.select("*", *(_over(kind, value).over(upto(group, out)).alias(name) for name, (kind, value, out) in values.items()))
    ranges = numbers_of(rows, RANGE)
    rows = one_task_each(rows, RANGE, ranges)
    inside = rows.select("*", *(_over(kind, value).over(upto([RANGE, *group], out)).alias(name) for name, (kind, value, out) in values.items()))
    own = rows.groupBy(*group, RANGE).agg(*(_of_range(kind, value, order).alias(name) for name, (kind, value, _) in values.items()))
    ahead = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    own = own.repartition(ranges, *group)  # groups may be as many as rows: adaptive execution would merge theirs into one task by their compressed bytes
    before = own.select(*(F.col(c).alias(f"_b_{c}") for c in (*group, RANGE)), *(_over(kind, F.col(name)).over(ahead).alias(f"_v_{name}") for name, (kind, _, _) in values.items()))
    before = before.filter(F.coalesce(*(F.col(f"_v_{name}").cast("string") for name in values)).isNotNull())
    same = [inside[c].eqNullSafe(before[f"_b_{c}"]) for c in group]
    # rows lie by group and order, so a range goes on with one group at most: no more rows than ranges
    met = inside.join(F.broadcast(before), [*same, inside[RANGE] == before[f"_b_{RANGE}"]], "left")
    return store(met.select(*rows.columns, *(_joined(kind, F.col(f"_v_{name}"), F.col(name)).alias(name) for name, (kind, _, _) in values.items())), "scanned")
