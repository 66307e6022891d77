"""Ranks and running totals over rows in hashed or fractional order, without a task that sees a whole group.

Rows fall into buckets by their place in the order. Bucket totals are few, so their running
sums are cheap; a window then orders only the rows inside one bucket. Ties are settled by the
columns given; rows equal in all of them are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a bucket that one window task orders, at least.
BUCKET_ROWS = 1024


def bucket_count(rows: int) -> int:
    """Buckets for so many rows: small ones first, then as many buckets as rows in each."""
    return max(1, rows // max(BUCKET_ROWS, math.isqrt(rows)))


def shuffled_key(seed: int, *columns: str) -> Column:
    """A hexadecimal order key any engine can compute; a null column counts as the text 'null'."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def key_bucket(key: str, buckets: int) -> Column:
    """The bucket of a hexadecimal key: ``buckets`` ranges of equal width."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets, 32)


def running(df: DataFrame, by: list[str], bucket: Column, order: list, amounts: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column``, ``name`` (running total within ``by``, own row included) and
    ``name_all`` (the group's total). ``bucket`` must not decrease along ``order``.

    Groups are compared null-safe, so null is a group like any other.
    """
    df = df.withColumn("__b", bucket)
    totals = df.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__{n}") for n, c in amounts.items()])
    upto = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)],
        F.col("__b").alias("__gb"),
        *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__before_{n}") for n in amounts],
        *[F.sum(f"__{n}").over(whole).alias(f"{n}_all") for n in amounts],
    )
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.sum(c).over(inside).alias(f"__in_{n}") for n, c in amounts.items()])
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)] + [F.col("__b") == F.col("__gb")]
    out = df.join(totals, same)
    for n in amounts:
        out = out.withColumn(n, F.col(f"__before_{n}") + F.col(f"__in_{n}"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
