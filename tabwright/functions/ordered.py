"""Running totals over a global order: range partitions, and the sums of the ranges before.

The table is sorted over ranges and written once; a row's running total is that of its range so far,
and the sums of its group in earlier ranges, which are a row for each range and group that meet.
No task sees more than a range of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.session import staged


def sorted_ranges(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """The table in order, written, with ``__range`` (ascending) and ``__at`` (ascending over the whole table).

    Spark picks the ranges by its own sizes. Give ``order`` columns enough to tell copies apart
    where a value may fill more than a range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    return staged(placed, label).withColumn("__range", F.shiftright("__at", 33))


def range_totals(placed: DataFrame, by: Sequence[str], amount: str, label: str) -> DataFrame:
    """(``__in``, __k0.., before, here, total): per range and group the amount in earlier ranges, in this one and in all."""
    keys = [f"__k{i}" for i in range(len(by))]
    sums = placed.groupBy(F.col("__range").alias("__in"), *[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.sum(amount).alias("here"))
    earlier = Window.partitionBy(*keys).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(sums.schema["here"].dataType)
    sums = sums.withColumn("before", F.coalesce(F.sum("here").over(earlier), zero)).withColumn("total", F.sum("here").over(Window.partitionBy(*keys)))
    return staged(sums, label)


def same_range(by: Sequence[str]) -> Column:
    """The join of a sorted table with its :func:`range_totals`; groups are compared null-safe."""
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    return reduce(lambda a, b: a & b, same, F.col("__range") == F.col("__in"))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], amount: str, through: str = "through", total: str = "total") -> DataFrame:
    """Adds the running total of ``amount`` within ``by`` along ``order`` (own row included) and the group's total."""
    placed = sorted_ranges(df, [*[F.col(c) for c in by], *order], "in-order")
    totals = range_totals(placed, by, amount, "range-totals").withColumnRenamed("total", "__total")
    inside = Window.partitionBy("__range", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(totals, same_range(by)).withColumn("__so_far", F.sum(amount).over(inside))
    return rows.select(*df.columns, (F.col("before") + F.col("__so_far")).alias(through), F.col("__total").alias(total))
