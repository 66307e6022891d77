"""Quality score (0-100) and the list of issues behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.functions import parse, stats
from tabwright.functions.text import name, quoted
from tabwright.operators import columns as C

# Name parts of columns expected to hold dates, and of amounts that
# should not be negative.
DATE_NAME_PARTS = ["date", "time", "created", "updated", "joined", "timestamp"]
AMOUNT_NAME_PARTS = [
    "amount", "price", "qty", "quantity", "cost", "total", "sales", "revenue", "units", "balance",
]

RATES = [
    "completeness", "duplicate_rate", "invalid_date_rate", "numeric_text_rate", "empty_constant_rate", "negative_rate",
]


def _named_like(column: str, parts: list[str]) -> bool:
    return any(part in column.lower() for part in parts)


def column_findings(df: DataFrame) -> DataFrame:
    """One row per column with the counts every quality rule needs. One scan, and one of the different texts."""
    strings, numeric, flat = set(C.string_columns(df)), set(C.numeric_columns(df)), set(C.flat_columns(df))

    def one(c: str):
        x, is_text, watched = name(c), c in strings, _named_like(c, AMOUNT_NAME_PARTS)
        return {
            "row_count": "count(*)",
            "filled": f"count({x})",
            "is_text": str(is_text).lower(),
            "date_name": str(_named_like(c, DATE_NAME_PARTS)).lower(),
            "watched": str(watched).lower(),
            "below_zero": f"count_if({x} < 0)" if watched and c in numeric else "0L",
            "one_value": f"coalesce(min({x}) = max({x}), false)" if c in flat and not is_text else "false",
        }

    found = C.per_column(df, df.columns, one)
    measures = {
        "dates_ok": lambda x: f"if({parse.read_date(x)} IS NULL, 0, 1)",
        "numbers_ok": lambda x: f"if({parse.read_currency(x)} IS NULL, 0, 1)",
        "text_below_zero": lambda x: f"if({parse.read_currency(x)} < 0, 1, 0)",
    }
    texts = [c for c in df.columns if c in strings]
    if texts:
        read = C.text_evidence(df, texts, measures).selectExpr("attribute", *measures, "distinct_count = 1 AS one_text")
        found = found.join(read, "attribute", "left")
    else:
        found = found.selectExpr("*", *[f"0L AS {key}" for key in measures], "false AS one_text")
    found = found.selectExpr(
        "attribute", "position", "row_count", "filled", "is_text", "date_name",
        "coalesce(dates_ok, 0L) AS dates_ok", "coalesce(numbers_ok, 0L) AS numbers_ok",
        "if(watched, below_zero + coalesce(text_below_zero, 0L), 0L) AS negatives",
        "one_value OR coalesce(one_text, false) AS one_value",
    )
    judged = found.selectExpr(
        "*", "filled > 0 AND is_text AND (date_name OR dates_ok >= greatest(1D, 0.4D * filled)) AS as_date"
    )
    return judged.selectExpr(
        "attribute", "position", "row_count", "filled", "negatives",
        "if(as_date, filled - dates_ok, 0L) AS bad_dates",
        "if(as_date, filled, 0L) AS date_cells",
        "filled > 0 AND is_text AND NOT as_date AND numbers_ok >= greatest(1D, 0.8D * filled) AS numeric_as_text",
        "filled = 0 AS is_empty",
        "filled > 0 AND one_value AS is_constant",
    )


def assess(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row: sizes, the six rates, the score and the nulls per column.

    ``rows``: the table's :func:`columns.duplicate_rows`, where they are known.
    """
    columns = column_findings(df).selectExpr(
        "count(*) AS column_count",
        "coalesce(avg(try_divide(filled, row_count)), 0D) AS completeness",
        "coalesce(try_divide(sum(bad_dates), sum(date_cells)), 0D) AS invalid_date_rate",
        "try_divide(count_if(numeric_as_text), count(*)) AS numeric_text_rate",
        "try_divide(count_if(is_empty) + count_if(is_constant), count(*)) AS empty_constant_rate",
        "try_divide(count_if(negatives > 0), count(*)) AS negative_rate",
        # One entry per column of the table.
        "map_from_entries(collect_list(struct(attribute, row_count - filled))) AS nulls",
    )
    rows = (rows or C.duplicate_rows(df)).selectExpr(
        "*", "coalesce(try_divide(duplicate_rows, row_count), 0D) AS duplicate_rate"
    )
    points = """completeness * 25D + (1 - duplicate_rate) * 20D + (1 - invalid_date_rate) * 15D
        + (1 - numeric_text_rate) * 15D + (1 - empty_constant_rate) * 15D + (1 - negative_rate) * 10D"""
    return C.with_row(rows, columns).selectExpr(
        "row_count", "column_count", "duplicate_rows", *RATES, "nulls",
        f"if(row_count = 0, 0, greatest(0, least(100, int(bround({points}, 0))))) AS score",
    )


def quality_score(df: DataFrame) -> DataFrame:
    """One row: sizes, the six rates and the score."""
    return assess(df).drop("nulls")


_NULL_PCT = "(100D * (row_count - filled) / row_count)"
# Severities and texts of the issues, each after the condition that raises it.
_COLUMN_ISSUES = [
    (
        f"{_NULL_PCT} > 10 AND {_NULL_PCT} < 100",
        f"if({_NULL_PCT} >= 50, 'high', 'medium')",
        f"format_string(\"Column '%s' has %s%% missing values.\", attribute, string(round({_NULL_PCT}, 1)))",
        "Impute missing values or remove sparse rows.",
    ),
    (
        "bad_dates > 0",
        "'high'",
        "format_string(\"Column '%s' contains %d date value(s) that failed date parsing.\", attribute, bad_dates)",
        "Standardize date strings into ISO format (YYYY-MM-DD).",
    ),
    (
        "numeric_as_text",
        "'medium'",
        "format_string(\"Column '%s' contains numeric values stored as text/string.\", attribute)",
        "Cast column to numeric (int/float) data type.",
    ),
    (
        "is_empty",
        "'high'",
        "format_string(\"Column '%s' is completely empty (100%% missing values).\", attribute)",
        "Drop empty column from dataset.",
    ),
    (
        "is_constant",
        "'low'",
        "format_string(\"Column '%s' contains a single constant value.\", attribute)",
        "Check if constant column can be dropped.",
    ),
    (
        "negatives > 0",
        "'high'",
        "format_string(\"Column '%s' contains %d negative value(s).\", attribute, negatives)",
        "Verify whether negative values represent invalid records or returns.",
    ),
]
_ROW_ISSUES = [
    (
        "row_count = 0",
        "'high'",
        "'Dataset is completely empty.'",
        "Upload a non-empty CSV/JSON/Excel/Parquet file.",
    ),
    (
        "duplicate_rows > 0",
        "'medium'",
        f"format_string('Found %d duplicate row(s) (%s%% of dataset).', duplicate_rows, "
        f"string({stats.percent('duplicate_rows', 'row_count', 1)}))",
        "Deduplicate rows to prevent skewed aggregations.",
    ),
]


def _issues(facts: DataFrame, rules: list[tuple[str, str, str, str]], attribute: str) -> DataFrame:
    found = [
        f"if({when}, struct({severity} AS severity, {attribute} AS attribute, {text} AS description, "
        f"{quoted(suggestion)} AS suggestion), NULL)"
        for when, severity, text, suggestion in rules
    ]
    return facts.select(F.expr(f"inline(array_compact(array({', '.join(found)})))"))


def quality_issues(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows (severity, attribute, description, suggestion), one per finding. ``rows`` as in :func:`assess`."""
    filled = column_findings(df).filter("row_count > 0")
    per_column = _issues(filled, _COLUMN_ISSUES, "attribute")
    return per_column.unionByName(_issues(rows or C.duplicate_rows(df), _ROW_ISSUES, "string(NULL)"))
