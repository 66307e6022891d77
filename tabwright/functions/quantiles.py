"""Exact interpolated quantiles per group, one way for every size and any skew.

Rows are first combined to (group, value, count), map-side, so neither a hot group nor a hot value
is ever moved row by row. The counts are sorted once over ranges; sums of ranges tell which of them
hold a wanted rank, and only in those are counts followed value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions import ordered


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    also: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per group: the group columns and ``quantiles`` (array, in order of probs).

    ``also`` names further aggregates over ``value`` as SQL text. Null is a group like any other;
    null values don't count, a group without others has no row. NaN is above infinity.
    """
    long = df.select(*by, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    keys = [f"__g{i}" for i in range(len(by))]
    named = long.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "value")
    cuts = _ranked(named, keys, list(probs))
    if not also:
        return cuts.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "quantiles")
    others = long.groupBy(*by).agg(*[F.expr(sql).alias(name) for name, sql in also.items()])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    return others.join(cuts, same).drop(*keys)


def _ranked(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Two ranks for each probability, those of the values below and above it."""
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    placed = ordered.sorted_ranges(counts, [*[F.col(k) for k in keys], F.col("value")], "value-counts")
    totals = ordered.range_totals(placed, keys, "c", "rank-ranges")
    places = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ends = [end(x).cast("long") for x in places for end in (F.floor, F.ceil)]
    totals = totals.withColumn("n", F.col("total"))
    targets = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("rank")) for i, x in enumerate(ends)])
    here = F.filter(targets, lambda t: (t["rank"] >= F.col("before")) & (t["rank"] < F.col("before") + F.col("here")))
    totals = totals.withColumn("targets", here).filter(F.size("targets") > 0).drop("here", "total")

    inside = Window.partitionBy("__range", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(totals, ordered.same_range(keys)).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    hit = F.filter("targets", lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= F.col("upto") - F.col("c")))
    found = rows.select(*keys, "n", "value", F.explode(hit).alias("t"))
    picked = F.map_from_entries(F.collect_list(F.struct(F.col("t.i"), F.col("value"))))
    picked = found.groupBy(*keys).agg(F.first("n").alias("n"), picked.alias("x"))  # two values for each probability
    return picked.select(*keys, F.array(*[_blend(place, 2 * i) for i, place in enumerate(places)]).alias("quantiles"))


def _blend(place: Column, i: int) -> Column:
    below, above = F.col("x")[i], F.col("x")[i + 1]
    mixed = (F.ceil(place) - place) * below + (place - F.floor(place)) * above
    return F.when(below == above, below).otherwise(mixed)
