"""Shared building blocks: per-column statistics in one scan, value counts in one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.text import name, quoted
from tabwright.session import spread

_NUMERIC = (T.NumericType,)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DATES)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be grouped and printed (nested ones pass through untouched)."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def col(column: str) -> Column:
    """Column by literal name, whatever characters it holds."""
    return F.col(name(column))


def per_column(df: DataFrame, columns: Sequence[str], stats: Callable[[str], Mapping[str, str]]) -> DataFrame:
    """One aggregation over all columns, turned into one row per column.

    ``stats`` maps a column name to named aggregates as SQL text; every column must give
    the same names and types.
    """
    rows = [
        f"struct({quoted(c)} AS attribute, {i} AS position, "
        + ", ".join(f"{sql} AS {key}" for key, sql in stats(c).items())
        + ")"
        for i, c in enumerate(columns)
    ]
    return df.agg(F.expr(f"array({', '.join(rows)})").alias("rows")).select(F.inline("rows"))


def _stacked(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    cells = spread(df.selectExpr(*[f"CAST({name(c)} AS {dtype}) AS {name(c)}" for c in columns]))
    return cells.unpivot([], [name(c) for c in columns], "attribute", "value").filter("value IS NOT NULL")


def schema_rows(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """(attribute, position): one row per column, whether or not it holds any value."""
    named = spark.range(1).selectExpr(f"posexplode(array({', '.join(map(quoted, columns))})) AS (position, attribute)")
    return named.select("attribute", "position")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, value): one row per cell of the numeric columns, as doubles."""
    return _stacked(df, columns, "double").filter("NOT isnan(value)")


def per_number(
    df: DataFrame, columns: Sequence[str], stats: Mapping[str, str], probs: Sequence[float] = ()
) -> DataFrame:
    """(attribute, position, n, ...): aggregates over ``value`` for every numeric column.

    Stacking the columns keeps the plan the same size for any number of them.
    """
    cells = long_numbers(df, columns)
    wanted = {"n": "count(value)", **stats}
    if probs:
        found = exact_quantiles(cells, ["attribute"], "value", probs, also=wanted)
    else:
        found = cells.groupBy("attribute").agg(*[F.expr(sql).alias(key) for key, sql in wanted.items()])
    listed = schema_rows(df.sparkSession, columns).join(found, "attribute", "left")
    return listed.withColumn("n", F.coalesce("n", F.lit(0)))


def _families(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the type their values are counted in."""
    whole = ("tinyint", "smallint", "int", "bigint")
    families: dict[str, list[str]] = {}
    for column, dtype in df.dtypes:
        if column in columns:
            families.setdefault("bigint" if dtype in whole else dtype, []).append(column)
    return families


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, value, n, num). The one shuffle behind distinct counts, top values and modes.

    Cells are counted in their own type, which keeps numbers small in the shuffle, and
    become text afterwards. ``num`` is the value of a number, so that numbers order as such.
    """
    result = None
    for dtype, members in _families(df, columns).items():
        counts = _stacked(df, members, dtype).groupBy("attribute", "value").agg(F.count("*").alias("n"))
        is_number = dtype in ("bigint", "float", "double") or dtype.startswith("decimal")
        num = "double(value)" if is_number else "double(NULL)"
        part = counts.selectExpr("attribute", "string(value) AS value", "n", f"{num} AS num")
        result = part if result is None else result.unionByName(part)
    return result


def short_keys(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns as SQL, long texts by digest and length, so that no whole text is shuffled as a key."""
    text = set(string_columns(df))
    key = "CASE WHEN octet_length({x}) <= 32 THEN {x} ELSE md5({x}) || octet_length({x}) END AS {x}"
    return [key.format(x=name(c)) if c in text else name(c) for c in columns]


#: Texts up to so many bytes are counted by themselves, longer ones by digest and length.
SHORT_TEXT = 64


def text_evidence(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Callable[[str], str]]) -> DataFrame:
    """(attribute, filled, distinct_count, ...): sums of whole-number ``measures`` over the cells of text columns.

    A measure turns the SQL text of a value into that of a number. Equal cells are combined first, so that
    costly readings are made once for each different text, and once in the plan for any number of columns. Long texts
    are read where they are and not shuffled. Columns without a filled cell have no row.
    """
    short = f"octet_length(value) <= {SHORT_TEXT}"
    split = _stacked(df, columns, "string").selectExpr(
        "attribute", f"CASE WHEN {short} THEN value ELSE md5(value) || octet_length(value) END AS key",
        f"CASE WHEN NOT {short} THEN value END AS long",
    )
    read = lambda x: ", ".join(f"bigint({sql(x)}) AS {name(key)}" for key, sql in measures.items())
    keyed = split.selectExpr("attribute", "key", f"CASE WHEN long IS NOT NULL THEN struct({read('long')}) END AS read")
    counts = keyed.groupBy("attribute", "key", "read").agg(F.count("*").alias("n"))
    texts = counts.selectExpr("attribute", "n", "read", "CASE WHEN read IS NULL THEN key END AS text")
    found = texts.selectExpr("attribute", "n", "read", f"struct({read('text')}) AS own")
    sums = [F.expr(f"sum(n * coalesce(read.{name(key)}, own.{name(key)}, 0))").alias(key) for key in measures]
    return found.groupBy("attribute").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_count"), *sums)


def distinct_counts(counts: DataFrame) -> DataFrame:
    # Reads n as well, so that this and the other users of the counts share one shuffle.
    return counts.groupBy("attribute").agg(F.count_if(F.col("n") > 0).alias("distinct_count"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column; ties by value. Pre-limited before the shuffle."""
    order = Window.partitionBy("attribute").orderBy(F.desc("n"), "num", "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def smallest_values(counts: DataFrame, k: int) -> DataFrame:
    # n settles no tie here; naming it lets this share the shuffle of the other users.
    order = Window.partitionBy("attribute").orderBy("num", "value", "n")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    best = F.min_by("value", F.struct((-F.col("n")).alias("c"), "num", "value"))
    return counts.groupBy("attribute").agg(best.alias("mode"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and how many repeat an earlier row (nulls equal).

    Equal rows are combined before the shuffle, so a row that makes up a third of
    the table costs one record per input partition.
    """
    copies = df.selectExpr(*short_keys(df, df.columns)).groupBy(*[name(c) for c in df.columns]).agg(F.expr("count(*)").alias("__copies"))
    return copies.selectExpr(
        "coalesce(sum(__copies), 0) AS row_count", "coalesce(sum(__copies - 1), 0) AS duplicate_rows"
    )


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row, as one scalar subquery."""
    row = one_row.select(F.struct(*[col(c) for c in one_row.columns]).alias("v")).scalar()
    attached = df.select("*", row.alias("__row"))
    return attached.select(*[col(c) for c in df.columns], *[F.col("__row")[c].alias(c) for c in one_row.columns])
