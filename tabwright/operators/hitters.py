"""Most frequent values without shuffling every different one: a summary proposes, a second pass counts.

The first pass keeps a bounded table of frequent items per column (Spark's top-k sketch, a Misra-Gries
summary that merges). Whatever it does not name has at most ``2 * ERROR`` of the column's cells. The
second pass counts the named values exactly. Where the k-th count is above what any other
value may have, the result is proven; the columns for which it is not (near-unique ones, long flat tails)
are counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.text import name, one_of, quoted
from tabwright.operators import columns as C
from tabwright.session import spread, staged

TRACKED = 8192
#: The sketch's error for so many items, as a share of all cells: 3.5 / the size of its table.
ERROR = 3.5 / 16384
#: Values counted again for each column, of those that the summary names.
AGAIN = 64

_COLUMNS = ["attribute", "value", "n", "num", "rank"]


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, key, value, num): one row per cell; long texts have a digest as their key."""
    numbers = set(C.numeric_columns(df))
    short = dict(zip(columns, C.short_keys(df, columns)))
    cell = "struct({q} AS attribute, string({key}) AS key, string({x}) AS value, {num} AS num)"
    rows = [
        cell.format(q=quoted(c), key=short[c].rsplit(" AS ", 1)[0] if " AS " in short[c] else name(c), x=name(c), num=f"double({name(c)})" if c in numbers else "double(NULL)")
        for c in columns
    ]
    return spread(df).select(F.inline(F.expr(f"array({', '.join(rows)})"))).filter("value IS NOT NULL")


def proposed(cells: DataFrame, again: int = AGAIN) -> DataFrame:
    """(attribute, cells, items): the values the summary names, the likeliest first, and their estimates."""
    summed = cells.groupBy("attribute").agg(F.count("*").alias("cells"), F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("sketch"))
    items = F.expr(f"approx_top_k_estimate(sketch, {again + 1})")
    return summed.select("attribute", "cells", items.alias("items"))


def top_values(df: DataFrame, columns: Sequence[str], k: int, again: int = AGAIN) -> tuple[DataFrame, list[str]]:
    """The k most frequent values per column as :func:`columns.top_values` gives them, and the columns that had to be
    counted in full. Ties go to the smaller value."""
    cells = _cells(df, columns)
    found = staged(proposed(cells, again), "proposed-values")
    named = found.select("attribute", F.inline(F.slice("items", F.lit(1), F.lit(again)))).select(F.col("attribute").alias("of"), F.col("item").alias("item"))
    # At most ``again`` values a column.
    counted = cells.join(F.broadcast(named), (F.col("attribute") == F.col("of")) & (F.col("key") == F.col("item")))
    counted = counted.groupBy("attribute", "key").agg(F.min("value").alias("value"), F.count("*").alias("n"), F.min("num").alias("num"))
    counted = staged(counted.select("attribute", "value", "n", "num"), "counted-values")
    top = C.top_values(counted, k).select(*_COLUMNS)
    # What an unnamed value may have, and the largest estimate that was left out.
    rest = F.greatest(2 * ERROR * F.col("cells"), F.coalesce(F.get(F.col("items"), F.lit(again))["count"], F.lit(0)))
    least = top.filter(F.col("rank") == k).select(F.col("attribute").alias("of"), F.col("n").alias("least"))
    verdicts = found.join(least, F.col("attribute") == F.col("of"), "left")
    proven = {r["attribute"] for r in verdicts.filter(F.col("least") > rest).select("attribute").collect()}  # a row per column
    seen = {r["attribute"] for r in found.select("attribute").collect()}
    full = [c for c in columns if c in seen and c not in proven]
    if not full:
        return top, full
    rows = C.top_values(C.value_counts(df, full), k).select(*_COLUMNS)
    kept = top.filter(one_of("attribute", sorted(proven))) if proven else top.limit(0)
    return kept.unionByName(rows), full
