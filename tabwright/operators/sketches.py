"""Mergeable column profiles: what a part of a table says about its columns, in a few kilobytes.

A part's sketch has one row per column: counts, ends, mean and squared deviations (exact), a HyperLogLog
sketch of its distinct values, a KLL sketch of its numbers' ranks and a table of its frequent values.
Sketches of several parts merge to that of the whole, so the profile of a growing table needs
its new part only. All of it is Spark's own sketch aggregates over stacked columns: one scan, and one
row per column and task in the shuffle.

Bounds, at the default sizes: distinct counts have a relative standard error of ``DISTINCT_ERROR``;
a quantile's rank is off by ``RANK_ERROR`` of all rows at most (99 % confidence); a value held by more
than ``rows / TRACKED * 3.5`` rows is among the frequent ones, its count off by that at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.text import name, quoted
from tabwright.operators import columns as C
from tabwright.session import spread

LOG_REGISTERS = 13
RANKS = 800
TRACKED = 8192
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 0.0035
#: Texts beyond this many bytes enter the table of frequent values by their beginning and digest.
SHOWN_BYTES = 64

COLUMNS = ["attribute", "position", "dtype", "rows", "n", "low", "high", "mean", "squares", "distinct", "ranks", "frequent"]


def sketch_table(df: DataFrame) -> DataFrame:
    """One row per flat column of a part: ``COLUMNS``."""
    flat = C.flat_columns(df)
    numeric, dtypes = set(C.numeric_columns(df)), dict(df.dtypes)
    cell = "struct({q} AS attribute, {i} AS position, {t} AS dtype, string({x}) AS shown, {num} AS num)"
    cells = ", ".join(
        cell.format(q=quoted(c), i=i, t=quoted(dtypes[c]), x=name(c), num=f"nanvl(double({name(c)}), NULL)" if c in numeric else "double(NULL)")
        for i, c in enumerate(flat)
    )
    stacked = spread(df).select(F.inline(F.expr(f"array({cells})")))
    short = f"CASE WHEN octet_length(shown) <= {SHOWN_BYTES} THEN shown ELSE concat(left(shown, 16), '...', md5(shown)) END"
    return stacked.groupBy("attribute", "position", "dtype").agg(
        F.count("*").alias("rows"), F.count("shown").alias("n"), F.min("num").alias("low"), F.max("num").alias("high"),
        F.avg("num").alias("mean"), (F.var_pop("num") * F.count("num")).alias("squares"),
        F.hll_sketch_agg("shown", LOG_REGISTERS).alias("distinct"),
        F.kll_sketch_agg_double("num", RANKS).alias("ranks"),
        F.expr(f"approx_top_k_accumulate({short}, {TRACKED})").alias("frequent"),
    )


def merge_sketches(parts: DataFrame) -> DataFrame:
    """The sketch of all parts together, one row per column. A column that some parts lack is null in their rows."""
    weight = F.kll_sketch_get_n_double("ranks")
    parts = parts.withColumn("__numbers", weight)
    middle = parts.groupBy("attribute").agg((F.sum(F.col("mean") * F.col("__numbers")) / F.sum("__numbers")).alias("__mean"))
    whole = parts.join(middle, "attribute")
    away = F.col("squares") + F.col("__numbers") * F.pow(F.col("mean") - F.col("__mean"), 2)
    return whole.groupBy("attribute").agg(
        F.min("position").alias("position"), F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.first("__mean").alias("mean"), F.sum(away).alias("squares"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks", RANKS).alias("ranks"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def read_sketches(sketches: DataFrame, k: int = 5, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile a sketch tells: counts, moments, distinct count, quantiles and the k most frequent values.

    Equal counts among the frequent values are in the order of the values.
    """
    numbers = F.kll_sketch_get_n_double("ranks")
    at = F.array(*[F.lit(float(p)) for p in probs])
    found = F.filter(F.expr("approx_top_k_estimate(frequent, 1000)"), lambda v: v["item"].isNotNull())
    order = F.array_sort(F.transform(found, lambda v: F.struct((-v["count"]).alias("c"), v["item"].alias("value"))))
    top = F.transform(F.slice(order, 1, k), lambda v: F.struct(v["value"].alias("value"), (-v["c"]).alias("n")))
    return sketches.select(
        "attribute", "position", "dtype", "rows", "n", "low", "high", "mean",
        F.when(numbers > 1, F.sqrt(F.col("squares") / (numbers - 1))).alias("std"),
        F.hll_sketch_estimate("distinct").alias("distinct_count"),
        F.when(numbers > 0, F.kll_sketch_get_quantile_double("ranks", at)).alias("quantiles"),
        top.alias("top"),
    )
