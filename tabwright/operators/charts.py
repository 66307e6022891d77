"""Chart data: bounded aggregates over all rows instead of raw points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.text import name
from tabwright.operators import columns as C

BINS = 20


def box(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary per numeric column."""
    cuts = exact_quantiles(C.long_numbers(df, columns), ["attribute"], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["low", "q1", "median", "q3", "high"]
    return cuts.select("attribute", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Bin 1..bins; the maximum belongs to the last bin and a constant column to the first."""
    at = F.floor(F.try_divide((value - low) * bins, high - low)) + 1
    return F.when(high > low, F.least(at, F.lit(bins))).otherwise(1).cast("int")


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(attribute, bin, n) with equal-width bins between each column's minimum and maximum."""
    cells = C.long_numbers(df, columns)
    # One row per column, so the broadcast side is bounded by the schema.
    bounds = C.per_column(
        df,
        columns,
        lambda c: {"low": f"double(min({name(c)}))", "high": f"double(max({name(c)}))"},
    ).drop("position")
    at = equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    placed = cells.join(F.broadcast(bounds), "attribute")
    return placed.groupBy("attribute", at.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(cells: DataFrame, row: str, col: str, value: str, labels: list[str]) -> DataFrame:
    """Matrix form of long cells; labels fix the columns, so no job looks for them."""
    return cells.groupBy(row).pivot(col, labels).agg(F.first(value))


def correlation_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric matrix with a unit diagonal from (col1, col2, correlation)."""

    def cell(row: str, col: str, value: Column) -> Column:
        return F.struct(F.col(row).alias("row"), F.col(col).alias("col"), value.alias("value"))

    r, one = F.col("correlation"), F.lit(1.0)
    mirrored = F.array(
        cell("col1", "col2", r), cell("col2", "col1", r), cell("col1", "col1", one), cell("col2", "col2", one)
    )
    cells = pairs.select(F.inline(mirrored))
    return heatmap(cells, "row", "col", "value", columns).withColumnRenamed("row", "col1")


def density(df: DataFrame, x: str, y: str, flag: str, bins: int = BINS) -> DataFrame:
    """(x_bin, y_bin, flag, n): every row of a scatter plot, counted on a grid."""
    numbers = df.select(C.col(x).cast("double").alias("x"), C.col(y).cast("double").alias("y"), C.col(flag).alias(flag))
    bounds = numbers.agg(
        F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high")
    )
    placed = C.with_row(numbers.filter("x is not null and y is not null"), bounds)
    return placed.groupBy(
        equal_width_bin(F.col("x"), F.col("x_low"), F.col("x_high"), bins).alias("x_bin"),
        equal_width_bin(F.col("y"), F.col("y_low"), F.col("y_high"), bins).alias("y_bin"),
        flag,
    ).agg(F.count("*").alias("n"))
