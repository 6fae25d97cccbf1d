"""Global offsets by two-pass prefix sums, without a task that sees all rows.

Pass one numbers rows inside each partition as it streams them (``part``, ``local``) and the result is
written, so that the numbers never change.  The totals of the partitions, one row each, are summed up
in order, and pass two adds a partition's offset to its rows.  The table of offsets has one row for
each task of the written job (and group), which bounds the broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(rows: DataFrame, size: str, groups: list[str] | None = None) -> DataFrame:
    """``rows`` (part, local, ...) -> the same with ``start``: the sum of ``size`` over all rows before it,
    partitions in the order of ``part``; with ``groups``, of its group only.  ``local`` is the sum over the
    partition's (and group's) earlier rows."""
    groups = groups or []
    totals = rows.groupBy("part", *groups).agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *groups, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), ["part", *groups]).withColumn(
        "start", F.col("_offset") + F.col("local")).drop("_offset")
