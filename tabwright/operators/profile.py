"""Column profiles, column roles and the profile-level quality score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tabwright.functions import parse, stats
from tabwright.functions.text import name, one_of, quoted
from tabwright.operators import columns as C, counted

SAMPLE_ALL_UP_TO = 20
SAMPLE_SIZE = 5


def null_stats(df: DataFrame) -> DataFrame:
    """Per column: null count, null percentage (1 dp) and completeness."""

    def one(c: str):
        missing = f"(count(*) - count({name(c)}))"
        return {
            "row_count": "count(*)",
            "null_count": missing,
            "null_pct": stats.percent(missing, "count(*)", 1),
            "completeness": f"try_divide(count({name(c)}), count(*))",
        }

    return C.per_column(df, df.columns, one)


def distinct(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values per column: exact from one shuffle, or a sketch in one scan."""
    flat = C.flat_columns(df)
    if approximate:
        sketched = C.per_column(df, flat, lambda c: {"distinct_count": f"approx_count_distinct({name(c)})"})
        return sketched.drop("position")
    # A column of nulls has no counts; the rows from the schema keep it in the result.
    found = C.distinct_counts(C.value_counts(df.selectExpr(*C.short_keys(df, flat)), flat))
    listed = C.schema_rows(df.sparkSession, flat).join(found, "attribute", "left")
    return listed.selectExpr("attribute", "coalesce(distinct_count, 0) AS distinct_count")


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: n, min, max, mean, std and the three quartiles."""
    moments = {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "std": stats.sample_std("value")}
    found = C.per_number(df, columns or C.numeric_columns(df), moments, probs=[0.25, 0.5, 0.75])
    return found.selectExpr(
        "attribute", "position", "n", *moments, "quantiles[0] AS p25", "quantiles[1] AS median", "quantiles[2] AS p75"
    )


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column with every profile statistic."""
    flat = C.flat_columns(df)
    numeric, dates = C.numeric_columns(df), C.date_columns(df)
    dtypes = dict(df.dtypes)

    def one(c: str):
        x, shown = name(c), c in numeric or c in dates
        return {
            "dtype": quoted(dtypes[c]),
            "row_count": "count(*)",
            "null_pct": stats.percent(f"(count(*) - count({x}))", "count(*)", 1),
            "min": parse.iso_text(f"min({x})", dtypes[c]) if shown else "string(NULL)",
            "max": parse.iso_text(f"max({x})", dtypes[c]) if shown else "string(NULL)",
            "mean": f"avg({counted.number(c)})" if c in numeric else "double(NULL)",
            "std": stats.sample_std(counted.number(c)) if c in numeric else "double(NULL)",
        }

    out = C.per_column(df, flat, one)
    # Distinct counts, top values, samples and quartiles come from the same value counts.
    distinct_counts, ranked = counted.facts(df, flat, SAMPLE_ALL_UP_TO, 5, [0.25, 0.5, 0.75])
    out = out.withColumn("distinct_count", F.array(*[F.lit(n).cast("long") for n in distinct_counts])[F.col("position")])
    out = out.join(ranked, "attribute", "left")
    is_number = one_of("attribute", numeric) if numeric else "false"
    return out.selectExpr(
        "attribute", "position", "dtype", "row_count", "null_pct", "distinct_count", "min", "max",
        "round(mean, 4) AS mean", "quantiles[1] AS median", "round(std, 4) AS std", "quantiles[0] AS p25", "quantiles[2] AS p75",
        f"""coalesce(slice(transform(first, s -> s.value), 1, if(distinct_count <= {SAMPLE_ALL_UP_TO}, {SAMPLE_ALL_UP_TO},
            {SAMPLE_SIZE})), CAST(array() AS ARRAY<STRING>)) AS sample_values""",
        f"""coalesce(if({is_number}, NULL, transform(most, s -> struct(s.value, s.n))),
            CAST(array() AS ARRAY<STRUCT<value: STRING, n: BIGINT>>)) AS top_5""",
        "try_divide(distinct_count, row_count) >= 0.95D AS is_candidate_id",
        "distinct_count <= 1 AS is_constant",
    )


# --- roles -------------------------------------------------------------------

ROLES = ["id", "datetime", "boolean", "numeric", "text", "categorical"]


def has_id_name(name: str) -> bool:
    """Names ending in 'id' as a word of its own, or holding uuid / guid / hash."""
    return bool(re.search(r"(^id|_id| id)$|uuid|guid|hash", name.lower()))


def role_evidence(df: DataFrame) -> DataFrame:
    """Per column: what the role rules look at, for texts with their distinct counts. One scan, and one of the different texts."""
    flat = C.flat_columns(df)
    numeric, strings, dates = C.numeric_columns(df), C.string_columns(df), C.date_columns(df)
    dtypes = dict(df.dtypes)

    def is_datetime(c: str, x: str) -> str:
        if c in dates:
            return "true"
        return f"{parse.epoch_unit(f'min({x})', f'max({x})')} IS NOT NULL" if c in numeric else "false"

    def is_boolean(c: str, x: str) -> str:
        if c in numeric:
            return f"coalesce(bool_and({x} IN (0, 1)), false)"
        return "true" if dtypes[c] == "boolean" else "false"

    def one(c: str):
        x = name(c)
        return {
            "dtype": quoted(dtypes[c]),
            "row_count": "count(*)",
            "null_count": f"count(*) - count({x})",
            "has_id_name": str(has_id_name(c)).lower(),
            "datetime_cells": is_datetime(c, x),
            "boolean_cells": is_boolean(c, x),
            "is_numeric": str(c in numeric).lower(),
            "is_string": str(c in strings).lower(),
        }

    found = C.per_column(df, flat, one)
    pairs = {f"pair{i}": pair for i, pair in enumerate(parse.BOOLEAN_PAIRS)}
    measures = {
        "looks": lambda x: f"if({parse.looks_like_date(x)}, 1, 0)",
        "reads": lambda x: f"if({parse.read_date(x)} IS NULL, 0, 1)",
        "characters": lambda x: f"length({x})",
        **{key: lambda x, pair=pair: f"if({one_of(parse.word(x), pair)}, 1, 0)" for key, pair in pairs.items()},
    }
    if strings:
        found = found.join(C.text_evidence(df, strings, measures), "attribute", "left")
    else:
        found = found.selectExpr("*", *[f"bigint(NULL) AS {key}" for key in ("filled", "distinct_count", *measures)])
    kept = ["attribute", "position", "dtype", "row_count", "null_count", "has_id_name", "is_numeric", "is_string"]
    return found.selectExpr(
        *kept,
        "datetime_cells OR coalesce(looks >= 0.7D * filled OR reads = filled, false) AS is_datetime",
        f"boolean_cells OR coalesce(filled IN ({', '.join(pairs)}), false) AS is_boolean",
        "try_divide(characters, filled) AS mean_length",
        "if(is_string, coalesce(distinct_count, 0L), NULL) AS distinct_texts",
    )


def profile_roles(df: DataFrame) -> DataFrame:
    """Role per column; the first rule that matches wins."""
    found, others = role_evidence(df), [c for c in C.flat_columns(df) if c not in C.string_columns(df)]
    if others:
        found = found.join(distinct(df.select(*[C.col(c) for c in others])), "attribute", "left")
    else:
        found = found.selectExpr("*", "bigint(NULL) AS distinct_count")
    return found.withColumn("distinct_count", F.coalesce("distinct_texts", "distinct_count")).selectExpr(
        "attribute", "position", "dtype", "row_count",
        f"{stats.percent('null_count', 'row_count', 2)} AS missing_pct",
        "distinct_count",
        """CASE WHEN has_id_name AND distinct_count >= least(5, floor(0.3D * row_count)) THEN 'id'
                WHEN is_datetime THEN 'datetime'
                WHEN is_boolean THEN 'boolean'
                WHEN is_numeric THEN 'numeric'
                WHEN try_divide(distinct_count, row_count) >= 0.85D AND row_count > 10 THEN 'id'
                WHEN is_string AND try_divide(distinct_count, row_count) > 0.5D AND mean_length > 25 THEN 'text'
                ELSE 'categorical' END AS role""",
    )


def detect_datetime_columns(df: DataFrame) -> DataFrame:
    return role_evidence(df).select("attribute", "is_datetime")


def detect_boolean_columns(df: DataFrame) -> DataFrame:
    return role_evidence(df).select("attribute", "is_boolean")


def quality_score_v1(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """100 less penalties for missing cells, duplicate rows and mostly empty columns.

    ``rows``: the table's :func:`columns.duplicate_rows`, where they are known.
    """
    columns = null_stats(df).withColumn("pct", F.expr(stats.percent("null_count", "row_count", 2))).selectExpr(
        "coalesce(avg(pct), 0D) AS avg_missing_pct", "count_if(pct >= 60) AS mostly_missing_columns"
    )
    rows = (rows or C.duplicate_rows(df)).selectExpr(
        "*", "coalesce(try_divide(100D * duplicate_rows, row_count), 0D) AS duplicate_pct"
    )
    penalty = "avg_missing_pct * 0.4D + duplicate_pct * 0.3D + mostly_missing_columns * 3D"
    return C.with_row(rows, columns).selectExpr(
        "*", f"greatest(0D, least(100D, round(100D - ({penalty}), 1))) AS score"
    )


def profile_samples(df: DataFrame, k: int = 3) -> DataFrame:
    """The k smallest distinct values of every column, as text."""
    counts = C.value_counts(df, C.flat_columns(df))
    return C.smallest_values(counts, k).select("attribute", "rank", "value")
