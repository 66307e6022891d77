"""Cleaning steps, each usable alone, and their composition with safety rails and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F

from tabwright.functions import parse
from tabwright.functions.names import unique_names
from tabwright.functions.text import name
from tabwright.operators import columns as C
from tabwright.operators import quality

# Safety rails and inference shares.
MAX_ROW_DROP_SHARE = 0.20
MIN_COLUMN_FILL = 0.50
DATE_SHARE = 0.80
CURRENCY_SHARE = 0.80


def name_mapping(df: DataFrame) -> dict[str, str]:
    return dict(zip(df.columns, unique_names(df.columns)))


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def column_fill(df: DataFrame) -> Row:
    """One job: row count, rows with every value null, and filled cells per column."""
    names = [name(c) for c in df.columns]
    return df.selectExpr(
        "count(*) AS rows",
        f"count_if(coalesce({', '.join(f'string({x} IS NOT NULL OR NULL)' for x in names)}) IS NULL) AS empty_rows",
        f"array({', '.join(f'count({x})' for x in names)}) AS filled",
    ).first()


def trimmed_fill(df: DataFrame) -> Row:
    """One job: the fill of the trimmed table, and that of the cells as delivered (``raw_filled``)."""
    cells = {c: parse.strip_to_null(name(c)) if c in set(C.string_columns(df)) else name(c) for c in df.columns}
    return df.selectExpr(
        "count(*) AS rows",
        f"count_if(coalesce({', '.join(f'string(({x}) IS NOT NULL OR NULL)' for x in cells.values())}) IS NULL) AS empty_rows",
        f"array({', '.join(f'count({x})' for x in cells.values())}) AS filled",
        f"array({', '.join(f'count({name(c)})' for c in df.columns)}) AS raw_filled",
    ).first()


def _drop_below(df: DataFrame, fill: Row, keep: Callable[[int, int], bool]) -> DataFrame:
    gone = [c for c, n in zip(df.columns, fill["filled"]) if not keep(n, fill["rows"])]
    return df.drop(*[C.col(c) for c in gone])


def drop_sparse_columns(df: DataFrame, fill: Row | None = None) -> DataFrame:
    """Drop columns filled in less than half of the rows."""
    fill = fill or column_fill(df)
    return _drop_below(df, fill, lambda n, rows: rows == 0 or n >= rows * MIN_COLUMN_FILL)


def drop_empty_columns(df: DataFrame, fill: Row | None = None) -> DataFrame:
    return _drop_below(df, fill or column_fill(df), lambda n, rows: n > 0)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip all text; text of whitespace only becomes null."""
    text = set(C.string_columns(df))
    return df.selectExpr(
        *[f"{parse.strip_to_null(name(c))} AS {name(c)}" if c in text else name(c) for c in df.columns]
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def within_row_rail(dropped: int, rows: int) -> bool:
    return rows == 0 or dropped / rows <= MAX_ROW_DROP_SHARE


def drop_empty_rows_guarded(df: DataFrame, fill: Row | None = None) -> tuple[DataFrame, list[str]]:
    """Drop empty rows unless that removes more than a fifth of the table."""
    fill = fill or column_fill(df)
    dropped, rows = fill["empty_rows"], fill["rows"]
    if within_row_rail(dropped, rows):
        return drop_empty_rows(df), []
    note = (
        f"Row cleaning skipped: would remove {dropped}/{rows} rows "
        f"({100 * dropped / rows:.0f}%), exceeding the 20% safety limit."
    )
    return df, [note]


# --- type inference ------------------------------------------------------------


def type_evidence(df: DataFrame) -> DataFrame:
    """Per text column: how many values read as boolean, date and currency."""
    texts = C.string_columns(df)
    measures = {
        "booleans": lambda x: f"if({parse.is_bool(x)}, 1, 0)",
        "dates": lambda x: f"if({parse.read_date(x)} IS NULL, 0, 1)",
        "currency": lambda x: f"if({parse.is_currency(x)}, 1, 0)",
    }
    found = C.text_evidence(df, texts, measures)
    counted = [f"coalesce({c}, 0L) AS {c}" for c in ("filled", *measures)]
    return C.schema_rows(df.sparkSession, texts).join(found, "attribute", "left").selectExpr("attribute", "position", *counted)


def inferred_types(evidence: DataFrame) -> DataFrame:
    """Decision per text column: boolean, timestamp, double or string."""
    return evidence.selectExpr(
        "*",
        f"""CASE WHEN filled = 0 THEN 'string' WHEN booleans = filled THEN 'boolean'
                 WHEN dates >= {DATE_SHARE}D * filled THEN 'timestamp'
                 WHEN currency > {CURRENCY_SHARE}D * filled THEN 'double' ELSE 'string' END AS inferred""",
    )


_READERS = {"boolean": parse.read_bool, "timestamp": parse.read_date, "double": parse.read_currency}


def infer_types(df: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Convert text columns whose values read as another type. One job decides."""
    if not C.string_columns(df):
        return df
    chosen = {r["attribute"]: r["inferred"] for r in inferred_types(type_evidence(df)).collect()}
    wanted = {c: t for c, t in chosen.items() if t != "string" and (only is None or t in only)}
    return df.selectExpr(
        *[f"{_READERS[wanted[c]](name(c))} AS {name(c)}" if c in wanted else name(c) for c in df.columns]
    )


# --- the whole chain -----------------------------------------------------------


@dataclass
class Cleaned:
    """Result of :func:`clean_table`; ``df`` is lazy unless a stage writer was given."""

    df: DataFrame
    raw: DataFrame
    mapping: dict[str, str]
    dropped_columns: list[str]
    empty_rows_dropped: int = 0
    warnings: list[str] = field(default_factory=list)

    def report(self, source: str, rows: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        return cleaning_report(self, source, rows)


def clean_table(raw: DataFrame, stage: Callable[[DataFrame], DataFrame] | None = None) -> Cleaned:
    """Names, sparse columns, trim, empty rows, duplicates, empty columns, types.

    Small jobs decide (fill counts, counted again when sparse columns go; then text evidence)
    and one lazy plan does the work.  ``stage`` may write the deduplicated rows once and read them back, so that the
    later jobs do not repeat the shuffle; large inputs should pass it.
    """
    mapping = name_mapping(raw)
    named = trim_strings(raw.toDF(*mapping.values()))
    both = trimmed_fill(raw.toDF(*mapping.values()))
    # Sparse columns are judged on the raw cells, as delivered.
    sparse = {c for c, n in zip(mapping.values(), both["raw_filled"]) if n < both["rows"] * MIN_COLUMN_FILL}
    kept = named.drop(*sparse)
    empty = [c for c, n in zip(mapping.values(), both["filled"]) if n == 0 and c not in sparse]
    # Dropping columns may empty further rows; only then a second count is needed.
    fill = column_fill(kept) if sparse else both
    rows, warnings = drop_empty_rows_guarded(kept, fill)
    unique = drop_duplicates(rows.drop(*empty))
    if stage:
        unique = stage(unique)
    dropped = sorted(sparse) + empty
    gone = 0 if warnings else fill["empty_rows"]
    return Cleaned(infer_types(unique), raw, mapping, dropped, gone, warnings)


def cleaning_report(cleaned: Cleaned, source: str, rows: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row describing what cleaning did, before and after.

    ``rows``: what :func:`columns.duplicate_rows` gives of the raw and the clean table, where it is known.
    """
    rows_before, rows_after = rows or (None, None)

    def assessed(df: DataFrame, when: str, rows: DataFrame | None) -> DataFrame:
        return quality.assess(df, rows).select(
            F.col("row_count").alias(f"rows_{when}"),
            F.col("duplicate_rows").alias(f"duplicates_{when}"),
            F.col("nulls").alias(f"nulls_per_column_{when}"),
            F.col("score").alias(f"score_{when}"),
        )

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    renamed = [F.lit(x) for raw, clean in cleaned.mapping.items() if raw != clean for x in (raw, clean)]
    both = C.with_row(assessed(cleaned.raw, "before", rows_before), assessed(cleaned.df, "after", rows_after))
    # A few issues per column at most.
    for df, known, label in ((cleaned.raw, rows_before, "raw_issues"), (cleaned.df, rows_after, "clean_issues")):
        both = C.with_row(both, quality.quality_issues(df, known).agg(F.array_sort(F.collect_list(F.struct("*"))).alias(label)))
    # Rows equal only after trimming are duplicates too; rows of nothing are not.
    removed = F.col("rows_before") - F.col("rows_after") - F.lit(cleaned.empty_rows_dropped)
    return both.select(
        F.lit(source).alias("source_name"),
        "rows_before",
        "rows_after",
        F.lit(len(cleaned.raw.columns)).alias("columns_before"),
        F.lit(len(cleaned.df.columns)).alias("columns_after"),
        F.greatest(F.col("duplicates_before"), removed).alias("duplicates_removed"),
        texts(cleaned.dropped_columns).alias("dropped_columns"),
        "nulls_per_column_before",
        "nulls_per_column_after",
        F.create_map(*renamed).cast("map<string,string>").alias("columns_renamed"),
        texts(["clean_column_names", "drop_empty_rows", "drop_duplicates", "type_inference"]).alias("operations"),
        texts(cleaned.warnings).alias("warnings"),
        F.col("score_before").alias("raw_score"),
        F.col("score_after").alias("clean_score"),
        F.when(F.size("raw_issues") > 0, F.col("raw_issues")).otherwise(F.col("clean_issues")).alias("issues"),
        "clean_issues",
    )
