"""Ranks in a total order, by range partitions: no task sees more than a range of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.session import staged

#: Rows of a range.
RANGE_ROWS = 20_000


def numbered(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds each row's place within ``by`` (a long, from 0, along ``order``) and the group's number of rows.

    The table is sorted by (``by``, ``order``) over ranges and written; a row's place follows from
    its place in its range and the rows of its group in earlier ranges. Give ``order`` enough columns
    to tell copies apart, or one key's rows share a range. Groups are compared null-safe. ``df``
    is read twice and should be a written table.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    keys = [*[F.col(c) for c in by], *order]
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = staged(placed.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy("__range", *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    shifts = counts.select(
        F.col("__range").alias("__of"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)],
        shift.alias("__shift"), F.sum("__n").over(Window.partitionBy(*by)).alias(total),
    )
    shifts = staged(shifts, "range-shifts")  # a row for each range and group that meet; its size is known from here on
    same = [F.col("__range") == F.col("__of")] + [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    out = placed.join(shifts, same).withColumn(rank, F.col("__at") + F.col("__shift"))
    return out.select(*df.columns, rank, total)
