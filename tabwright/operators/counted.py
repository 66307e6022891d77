"""What a profile reads off the value counts of a table: distinct counts, first and most frequent values, quartiles.

The counts are written once and never sorted whole. Values fall into hash buckets; as many buckets as values are wanted
hold that many different values, so the wanted ones lie within the bound that the buckets' smallest give. A sketch of
each number column brackets its quartiles, the counts below and in the brackets prove it. Only what lies within these bounds is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.text import name
from tabwright.operators import columns as C
from tabwright.session import staged, unstaged

BUCKETS = 256
#: Size of the quantile sketches, and the brackets' share of the rows to each side: three times a sketch's usual error.
SKETCH = 4000
MARGIN = 0.004

_DAYS = ("date", "timestamp", "timestamp_ntz")


def _is_number(dtype: str) -> bool:
    return dtype in ("bigint", "float", "double") or dtype.startswith("decimal")


def _written(df: DataFrame, columns: Sequence[str], families: dict[str, list[str]]) -> DataFrame:
    """(at, n, v0, v1, ...): the different values of every column, by its position, with a column for each type."""
    stored = [dtype if dtype != "void" else "string" for dtype in families]
    result = None
    for i, (dtype, members) in enumerate(families.items()):
        # Short names of columns make short keys.
        named = df.selectExpr(*[f"{name(c)} AS {name(str(columns.index(c)))}" for c in members])
        counts = C._stacked(named, named.columns, dtype).groupBy("attribute", "value").agg(F.count("*").alias("n"))
        values = [f"CAST({'value' if j == i else 'NULL'} AS {kind}) AS v{j}" for j, kind in enumerate(stored)]
        part = counts.selectExpr("int(attribute) AS at", "n", *values)
        result = part if result is None else result.unionByName(part)
    return staged(result, "counted")


def _read(counts: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(at, n, value, num, key, bucket): ``key`` never falls along (num, value); it is one for all texts."""
    numbers, keys = ["double(NULL)"], []
    for i, dtype in enumerate(families):
        if _is_number(dtype):
            numbers.insert(0, f"double(v{i})")
            keys.append(f"double(v{i})")
        elif dtype in _DAYS:
            # As texts, years of other than four digits come first.
            keys.append(
                f"CASE WHEN date(v{i}) BETWEEN DATE'0001-01-01' AND DATE'9999-12-31' THEN double(unix_date(date(v{i})))"
                f" WHEN v{i} IS NOT NULL THEN double('-Infinity') END"
            )
    values = [f"v{i}" for i in range(len(families))]
    return counts.selectExpr(
        "at", "n", f"coalesce({', '.join(f'string({v})' for v in values)}) AS value", f"coalesce({', '.join(numbers)}) AS num",
        f"coalesce({', '.join([*keys, '0D'])}) AS key", f"pmod(xxhash64({', '.join(values)}), {BUCKETS}) AS bucket",
    )


def _each(values: Sequence, dtype: str, at: str = "at") -> Column:
    """A column's own of some fixed values, by its position."""
    return F.array(*[F.lit(v).cast(dtype) for v in values])[F.col(at)]


def _brackets(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], probs: Sequence[float]) -> list[list[tuple]]:
    """Per probability and column: values below and above the quantile by a sketch, or nulls."""
    ends = [min(1.0, max(0.0, p + side * MARGIN)) for p in probs for side in (-1, 1)]
    wanted = [c for c in columns if c in numeric]
    found = {}
    if wanted:
        ranks = f"array({', '.join(f'{e!r}D' for e in ends)})"
        sketch = "CASE WHEN count({x}) > 0 THEN kll_sketch_get_quantile_double(kll_sketch_agg_double({x}, {k}), {ranks}) END AS q{i}"
        found = df.selectExpr(*[f"{number(c)} AS c{i}" for i, c in enumerate(wanted)])
        found = found.selectExpr(*[sketch.format(x=f"c{i}", k=SKETCH, ranks=ranks, i=i) for i in range(len(wanted))]).first()
        found = dict(zip(wanted, found))
    none = [None] * len(ends)
    rows = [found.get(c) or none for c in columns]
    return [[(row[2 * j], row[2 * j + 1]) for row in rows] for j in range(len(probs))]


def number(column: str) -> str:
    """A cell of a number column as a double, NaN as null."""
    x = f"double({name(column)})"
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def facts(df: DataFrame, columns: Sequence[str], first: int, most: int, probs: Sequence[float]) -> tuple[list[int], DataFrame]:
    """Distinct counts in the order of ``columns``, and per column what is ranked.

    (attribute, first, most, quantiles): the ``first`` smallest values as (rank, value), the ``most`` frequent ones of columns
    other than numbers as (rank, value, n), and exact interpolated quantiles of numbers. Columns without values have no row.
    """
    columns, numeric = list(columns), C.numeric_columns(df)
    families = C._families(df.select(*[C.col(c) for c in columns]), columns)
    written = _written(df, columns, families)
    counts = _read(written, families)
    brackets = _brackets(df, columns, numeric, probs)
    lows = [_each([b[0] for b in row], "double") for row in brackets]
    highs = [_each([b[1] for b in row], "double") for row in brackets]
    text = [i for i, c in enumerate(columns) if not any(c in m for d, m in families.items() if _is_number(d) or d in _DAYS)]
    is_text = _each([i in text for i in range(len(columns))], "boolean")
    is_number = _each([c in numeric for c in columns], "boolean")

    # One scan: distinct values, bounds of the first values and of the highest counts, and the ranks at the brackets.
    sums = {"numbers": F.col("num").isNotNull() & ~F.isnan("num")}
    for j, (low, high) in enumerate(zip(lows, highs)):
        sums |= {f"below{j}": F.col("num") < low, f"upto{j}": F.col("num") <= high}
    each = [F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(key) for key, when in sums.items()]
    buckets = counts.groupBy("at", "bucket").agg(F.count("*").alias("d"), F.min("key").alias("key"), F.max("n").alias("n"), *each)
    facts = buckets.groupBy("at").agg(
        F.sum("d").alias("d"), F.get(F.sort_array(F.collect_list("key")), F.lit(first - 1)).alias("bound"),
        F.get(F.sort_array(F.collect_list("n"), False), F.lit(most - 1)).alias("often"), *[F.sum(key).alias(key) for key in sums],
    )
    found = {r["at"]: r for r in facts.collect()}  # a row for each column
    of = lambda key: [found[i][key] if i in found else None for i in range(len(columns))]
    bound, often = _each(of("bound"), "double"), F.coalesce(_each(of("often"), "long"), F.lit(0))
    frequent = ~is_number & (F.col("n") >= often)
    # Of the values that reach the count, those by which the others at that count are beaten.
    tied = counts.filter(frequent & ~is_text).groupBy("at", "bucket").agg(F.min("key").alias("key"))
    tied = tied.groupBy("at").agg(F.get(F.sort_array(F.collect_list("key")), F.lit(most - 1)).alias("key"))
    beaten = {r["at"]: r["key"] for r in tied.collect()} if len(numeric) + len(text) < len(columns) else {}
    tie = _each([beaten.get(i) for i in range(len(columns))], "double")
    frequent = frequent & ((F.col("n") > often) | F.coalesce(F.col("key") <= tie, F.lit(True)))

    near = F.coalesce(F.col("key") <= bound, F.lit(True))
    for low, high in zip(lows, highs):
        near = near | F.coalesce((F.col("num") >= low) & (F.col("num") <= high), F.lit(False))
    attribute = _each(columns, "string").alias("attribute")
    few = counts.filter(~is_text & (near | frequent)).select(attribute, "at", "value", "n", "num")
    if text:
        texts = counts.filter(is_text).select(attribute, "at", "value", "n", "num")
        kept = C.smallest_values(texts, first).unionByName(C.top_values(texts.filter(F.col("n") >= often), most))
        few = few.unionByName(kept.drop("rank").dropDuplicates(["at", "value"]))
    few = staged(few, "ranked")
    unstaged(written)

    # All that is ranked shares one shuffle of these few rows; each reads the same columns.
    few, by = few.repartition("attribute"), Window.partitionBy("attribute")
    rank = lambda *order: F.row_number().over(by.orderBy(*order)).alias("rank")
    listed = lambda key, *fields: F.array_sort(F.collect_list(F.struct(*fields))).alias(key)
    firsts = few.select("attribute", "value", rank("num", "value", "n", "at")).filter(F.col("rank") <= first)
    mosts = few.select("attribute", "value", "n", rank(F.desc("n"), "num", "value", "at")).filter(F.col("rank") <= most)
    out = firsts.groupBy("attribute").agg(listed("first", "rank", "value"))
    out = out.join(mosts.groupBy("attribute").agg(listed("most", "rank", "value", "n")), "attribute")

    places = [[None if not n else p * (n - 1) for n in of("numbers")] for p in probs]
    proven = [
        n is None or place is None or (a <= math.floor(place) and math.ceil(place) < b)
        for j, row in enumerate(places) for n, place, a, b in zip(of("numbers"), row, of(f"below{j}"), of(f"upto{j}"))
    ]
    unproven = {i % len(columns) for i, fine in enumerate(proven) if not fine}
    ranked, hits = few, []
    for j, (low, high) in enumerate(zip(lows, highs)):
        here = F.when((F.col("num") >= low) & (F.col("num") <= high), F.col("n")).otherwise(0)
        within = F.sum(here).over(by.orderBy("num", "value", "n", "at").rowsBetween(Window.unboundedPreceding, 0))
        ranked = ranked.withColumn(f"here{j}", here).withColumn(f"to{j}", _each(of(f"below{j}"), "long") + within)
        for side, end in (("a", math.floor), ("b", math.ceil)):
            target = _each([None if x is None else end(x) for x in places[j]], "long")
            hit = (target < F.col(f"to{j}")) & (target >= F.col(f"to{j}") - F.col(f"here{j}"))
            hits.append(F.max(F.when(hit, F.col("num"))).alias(f"{side}{j}"))
    ends = ranked.filter(is_number).groupBy("attribute", "at").agg(*hits)
    blended = []
    for j, row in enumerate(places):
        up = _each([None if x is None else math.ceil(x) - x for x in row], "double")
        down = _each([None if x is None else x - math.floor(x) for x in row], "double")
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        blended.append(F.when(a == b, a).otherwise(up * a + down * b))
    cuts = ends.filter(~_each([i in unproven for i in range(len(columns))], "boolean")).select("attribute", F.array(*blended).alias("quantiles"))
    if unproven:
        rest = C.long_numbers(df, [columns[i] for i in sorted(unproven)])
        cuts = cuts.unionByName(exact_quantiles(rest, ["attribute"], "value", probs))
    return [d or 0 for d in of("d")], out.join(cuts, "attribute", "left")
