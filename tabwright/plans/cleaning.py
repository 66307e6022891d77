"""Cleaning and quality queries over a messy export of the whole orders table.

The export spells the same facts badly: padded text, five date spellings, money as
text, words for booleans, sparse and blank columns, repeated rows and rows of nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.operators import clean, columns as C, quality
from tabwright.plans.registry import Tables, register
from tabwright.plans.values import MIXED_DATE_SQL, MONEY_SQL, READ_DATE_SQL, each, mixed_date_text, money_text
from tabwright.session import spread, staged

RAW_NAMES = [
    " Order ID ", "Customer-Name", "Order Date", "Total Amount", "Rush?", "Notes", "Discount Code", "Balance",
    "Channel", "Blank",
]
CLEAN_NAMES = [
    "order_id", "customer_name", "order_date", "total_amount", "rush", "notes", "discount_code", "balance",
    "channel", "blank",
]


def messy_orders(t: Tables) -> DataFrame:
    o = spread(t.orders).withColumn("copies", F.when(F.col("o_totalprice") > 480000, 2).otherwise(1))
    o = o.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    date = F.when((priority == "5-LOW") & (status != "F"), F.col("o_orderdate").cast("date").cast("string")).otherwise(
        mixed_date_text(F.col("o_orderdate"), priority)
    )
    cells = [
        F.col("o_orderkey"),
        F.concat(F.lit("  Customer "), F.col("o_custkey").cast("string"), F.lit("\t")),
        date,
        money_text(price),
        F.when(priority == "1-URGENT", " Yes").when(priority == "2-HIGH", "yes ").otherwise("no"),
        F.when(price > 450000, "review"),
        F.when(status != "P", F.concat(F.lit("SAVE "), priority)),
        price - 20000.0,
        F.lit("web"),
        F.lit("   "),
    ]
    return o.select(*[F.when(price >= 5000, cell).alias(name) for name, cell in zip(RAW_NAMES, cells)])


_MESSY_CELLS = [
    "o_orderkey",
    "'  Customer ' || o_custkey || chr(9)",
    f"CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE {MIXED_DATE_SQL} END",
    MONEY_SQL,
    "CASE o_orderpriority WHEN '1-URGENT' THEN ' Yes' WHEN '2-HIGH' THEN 'yes ' ELSE 'no' END",
    "CASE WHEN o_totalprice > 450000 THEN 'review' END",
    "CASE WHEN o_orderstatus <> 'P' THEN 'SAVE ' || o_orderpriority END",
    "o_totalprice - 20000.0",
    "'web'",
    "'   '",
]
_CELLS_SQL = ", ".join(
    f"CASE WHEN o_totalprice >= 5000 THEN {cell} END AS {name}" for cell, name in zip(_MESSY_CELLS, CLEAN_NAMES)
)
MESSY_SQL = f"""raw AS (SELECT {_CELLS_SQL} FROM orders
  UNION ALL SELECT {_CELLS_SQL} FROM orders WHERE o_totalprice > 480000)"""

_TEXT = {"customer_name", "order_date", "total_amount", "rush", "notes", "discount_code", "channel", "blank"}


def _trimmed(name: str) -> str:
    return rf"nullif(regexp_replace({name}, '^\s+|\s+$', '', 'g'), '') AS {name}" if name in _TEXT else name


TRIMMED_SQL = f"""trimmed AS (SELECT {', '.join(_trimmed(n) for n in CLEAN_NAMES)} FROM raw)"""
_ALL = ", ".join(CLEAN_NAMES)
_ANY = " OR ".join(f"{n} IS NOT NULL" for n in CLEAN_NAMES)


def with_clean_names(t: Tables) -> DataFrame:
    return clean.clean_names(messy_orders(t))


def trimmed(t: Tables) -> DataFrame:
    return clean.trim_strings(with_clean_names(t))


# --- single steps ----------------------------------------------------------------------


@register("clean_names", f"WITH {MESSY_SQL} SELECT {_ALL} FROM raw")
def clean_names(t):
    return with_clean_names(t)


@register(
    "clean_drop_sparse_cols",
    f"WITH {MESSY_SQL} SELECT {', '.join(n for n in CLEAN_NAMES if n != 'notes')} FROM raw",
)
def clean_drop_sparse_cols(t):
    return clean.drop_sparse_columns(with_clean_names(t))


@register("clean_trim", f"WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT * FROM trimmed")
def clean_trim(t):
    return trimmed(t)


@register("clean_empty_rows", f"WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT * FROM trimmed WHERE {_ANY}")
def clean_empty_rows(t):
    return clean.drop_empty_rows(trimmed(t))


@register("clean_dedup", f"WITH {MESSY_SQL} SELECT DISTINCT * FROM raw")
def clean_dedup(t):
    return clean.drop_duplicates(with_clean_names(t))


@register(
    "clean_empty_cols",
    f"WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT {', '.join(n for n in CLEAN_NAMES if n != 'blank')} FROM trimmed",
)
def clean_empty_cols(t):
    return clean.drop_empty_columns(trimmed(t))


@register(
    "clean_row_rail",
    """WITH d AS (SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
            n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE quality IS NULL AND toxic IS NULL) AS empty FROM d)
       SELECT rows AS rows_before, CASE WHEN empty <= 0.2 * rows THEN rows - empty ELSE rows END AS rows_after,
              CASE WHEN empty > 0.2 * rows THEN 'Row cleaning skipped: would remove ' || empty || '/' || rows || ' rows (' ||
                printf('%.0f', 100.0 * empty / rows) || '%), exceeding the 20% safety limit.' ELSE '' END AS warning FROM n""",
)
def clean_row_rail(t):
    marks = t.documents.join(t.labels, "doc_id", "left").select("quality", "toxic")
    kept, warnings = clean.drop_empty_rows_guarded(marks)
    before = marks.agg(F.count("*").alias("rows_before"))
    after = kept.agg(F.count("*").alias("rows_after"))
    return C.with_row(before, after).withColumn("warning", F.lit(" ".join(warnings)))


@register(
    "infer_bool",
    f"""WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT order_id, CASE lower(rush) WHEN 'yes' THEN true WHEN 'no' THEN false END AS rush,
        discount_code FROM trimmed""",
)
def infer_bool(t):
    rows = trimmed(t).select("order_id", "rush", "discount_code")
    return clean.infer_types(rows, only={"boolean"})


@register(
    "infer_date",
    f"""WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT order_id, {READ_DATE_SQL.format(x='order_date')}::VARCHAR AS order_date, customer_name
        FROM trimmed""",
)
def infer_date(t):
    rows = trimmed(t).select("order_id", "order_date", "customer_name")
    dated = clean.infer_types(rows, only={"timestamp"})
    return dated.withColumn("order_date", F.col("order_date").cast("string"))


@register(
    "infer_numeric_text",
    f"""WITH {MESSY_SQL}, {TRIMMED_SQL} SELECT order_id, TRY_CAST(regexp_replace(total_amount, '[$€£₹¥,\\s]', '', 'g') AS DOUBLE) AS total_amount,
        customer_name FROM trimmed""",
)
def infer_numeric_text(t):
    rows = trimmed(t).select("order_id", "total_amount", "customer_name")
    return clean.infer_types(rows, only={"double"})


# --- the chain ---------------------------------------------------------------------------

CLEANED_SQL = f"""WITH {MESSY_SQL}, {TRIMMED_SQL}, cleaned AS (
  SELECT DISTINCT order_id, customer_name, {READ_DATE_SQL.format(x='order_date')} AS order_date,
    TRY_CAST(regexp_replace(total_amount, '[$€£₹¥,\\s]', '', 'g') AS DOUBLE) AS total_amount,
    lower(rush) = 'yes' AS rush, discount_code, balance, channel
  FROM trimmed WHERE {_ANY})
"""


def staged_cleaning(t: Tables) -> clean.Cleaned:
    """The whole chain as large inputs take it: the deduplicated rows are written once."""
    return clean.clean_table(messy_orders(t), stage=lambda df: staged(df, "clean"))


@register(
    "clean_table",
    CLEANED_SQL + "SELECT * REPLACE (order_date::VARCHAR AS order_date) FROM cleaned",
)
def clean_table(t):
    cleaned = staged_cleaning(t).df
    return cleaned.withColumn("order_date", F.col("order_date").cast("string"))


# --- quality ---------------------------------------------------------------------------

_MONEY_NUMBER = r"TRY_CAST(regexp_replace({c}, '[$€£₹¥,\s]', '', 'g') AS DOUBLE)"
_DATE_NAMED = {"order_date"}
_AMOUNT_NAMED = {"total_amount", "balance"}


def _finding_sql(source: str, text: set[str], names: list[str]) -> str:
    def one(i: int, c: str) -> str:
        is_text = c in text
        dates = f"count({READ_DATE_SQL.format(x=c)})" if is_text else "0"
        numbers = f"count({_MONEY_NUMBER.format(c=c)})" if is_text else "0"
        number = _MONEY_NUMBER.format(c=c) if is_text else c
        negatives = f"count(*) FILTER (WHERE {number} < 0)" if c in _AMOUNT_NAMED else "0"
        return (
            f"SELECT '{c}' AS attribute, {i} AS position, count(*) AS rows, count({c}) AS filled, {is_text} AS is_text, "
            f"{c in _DATE_NAMED} AS date_name, {dates} AS dates_ok, {numbers} AS numbers_ok, {negatives} AS negatives, "
            f"coalesce(min({c}) = max({c}), false) AS one_value FROM {source}"
        )

    stacked = "\nUNION ALL ".join(one(i, c) for i, c in enumerate(names))
    return f"""found AS ({stacked}),
judged AS (SELECT *, filled > 0 AND is_text AND (date_name OR dates_ok >= greatest(1, filled * 0.4)) AS as_date FROM found),
columns AS (SELECT *, filled > 0 AND is_text AND NOT as_date AND numbers_ok >= greatest(1, filled * 0.8) AS as_number,
  filled = 0 AS is_empty, filled > 0 AND one_value AS is_constant,
  CASE WHEN as_date THEN filled - dates_ok ELSE 0 END AS bad_dates, CASE WHEN as_date THEN filled ELSE 0 END AS date_cells FROM judged),
dupes AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS n, count(*) AS rows FROM {source})"""


_SCORE_SQL = """,
rates AS (SELECT count(*) AS column_count, avg(filled / rows) AS completeness,
    coalesce(sum(bad_dates) / nullif(sum(date_cells), 0), 0) AS invalid_date_rate,
    count(*) FILTER (WHERE as_number) / count(*) AS numeric_text_rate,
    (count(*) FILTER (WHERE is_empty) + count(*) FILTER (WHERE is_constant)) / count(*) AS empty_constant_rate,
    count(*) FILTER (WHERE negatives > 0) / count(*) AS negative_rate FROM columns)
SELECT d.rows AS row_count, column_count, d.n AS duplicate_rows, round(completeness, 6) AS completeness,
  round(d.n / d.rows, 6) AS duplicate_rate, round(invalid_date_rate, 6) AS invalid_date_rate,
  round(numeric_text_rate, 6) AS numeric_text_rate, round(empty_constant_rate, 6) AS empty_constant_rate,
  round(negative_rate, 6) AS negative_rate,
  greatest(0, least(100, round_even(completeness * 25 + (1 - d.n / d.rows) * 20 + (1 - invalid_date_rate) * 15
    + (1 - numeric_text_rate) * 15 + (1 - empty_constant_rate) * 15 + (1 - negative_rate) * 10, 0)))::INTEGER AS score
FROM rates, dupes d"""
def rounded_score(df: DataFrame) -> DataFrame:
    return quality.quality_score(df).withColumns({c: F.round(c, 6) for c in quality.RATES})


@register("quality_score_v2", f"WITH {MESSY_SQL}, {_finding_sql('raw', _TEXT, CLEAN_NAMES)}{_SCORE_SQL}")
def quality_score_v2(t):
    return rounded_score(with_clean_names(t))


_CLEAN_TEXT = {"customer_name", "discount_code", "channel"}
CLEANED_NAMES = [
    "order_id", "customer_name", "order_date", "total_amount", "rush", "discount_code", "balance", "channel",
]


@register(
    "quality_score_v2_cleaned",
    CLEANED_SQL.rstrip() + f", {_finding_sql('cleaned', _CLEAN_TEXT, CLEANED_NAMES)}{_SCORE_SQL}",
)
def quality_score_v2_cleaned(t):
    return rounded_score(staged_cleaning(t).df)


_ISSUES_SQL = """SELECT CASE WHEN (rows - filled) * 100.0 / rows >= 50 THEN 'high' ELSE 'medium' END AS severity, attribute,
  'Column ''' || attribute || ''' has ' || round((rows - filled) * 100.0 / rows, 1)::DOUBLE || '% missing values.' AS description,
  'Impute missing values or remove sparse rows.' AS suggestion
FROM columns WHERE (rows - filled) * 100.0 / rows > 10 AND filled > 0
UNION ALL SELECT 'high', attribute, 'Column ''' || attribute || ''' contains ' || bad_dates || ' date value(s) that failed date parsing.',
  'Standardize date strings into ISO format (YYYY-MM-DD).' FROM columns WHERE bad_dates > 0
UNION ALL SELECT 'medium', attribute, 'Column ''' || attribute || ''' contains numeric values stored as text/string.',
  'Cast column to numeric (int/float) data type.' FROM columns WHERE as_number
UNION ALL SELECT 'high', attribute, 'Column ''' || attribute || ''' is completely empty (100% missing values).',
  'Drop empty column from dataset.' FROM columns WHERE is_empty
UNION ALL SELECT 'low', attribute, 'Column ''' || attribute || ''' contains a single constant value.',
  'Check if constant column can be dropped.' FROM columns WHERE is_constant
UNION ALL SELECT 'high', attribute, 'Column ''' || attribute || ''' contains ' || negatives || ' negative value(s).',
  'Verify whether negative values represent invalid records or returns.' FROM columns WHERE negatives > 0
UNION ALL SELECT 'medium', NULL, 'Found ' || n || ' duplicate row(s) (' || round(n * 100.0 / rows, 1)::DOUBLE || '% of dataset).',
  'Deduplicate rows to prevent skewed aggregations.' FROM dupes WHERE n > 0"""


@register("quality_issues", f"WITH {MESSY_SQL}, {_finding_sql('raw', _TEXT, CLEAN_NAMES)} {_ISSUES_SQL}")
def quality_issues(t):
    return quality.quality_issues(with_clean_names(t))


_FOUND_RAW, _FOUND_CLEAN = _finding_sql("raw", _TEXT, CLEAN_NAMES), _finding_sql("cleaned", _CLEAN_TEXT, CLEANED_NAMES)


def _nulls_sql(source: str, names: list[str]) -> str:
    return " || '|' || ".join(f"'{n}:' || (SELECT count(*) - count({n}) FROM {source})" for n in sorted(names))


@register(
    "cleaning_report",
    f"""{CLEANED_SQL.rstrip()}, sizes AS (SELECT (SELECT count(*) FROM raw) AS b, (SELECT count(*) FROM cleaned) AS a,
      (SELECT count(*) FROM trimmed WHERE NOT ({_ANY})) AS e)
    SELECT 'messy_orders' AS source_name, b AS rows_before, a AS rows_after, 10 AS columns_before, 8 AS columns_after,
      greatest((WITH {_FOUND_RAW} SELECT n FROM dupes), b - a - e) AS duplicates_removed, 'notes|blank' AS dropped_columns,
      {_nulls_sql('cleaned', CLEANED_NAMES)} AS nulls_after,
      (SELECT score FROM (WITH {_FOUND_RAW}{_SCORE_SQL})) AS raw_score, (SELECT score FROM (WITH {_FOUND_CLEAN}{_SCORE_SQL})) AS clean_score,
      (SELECT count(*) FROM (WITH {_FOUND_RAW} {_ISSUES_SQL})) AS issues, (SELECT count(*) FROM (WITH {_FOUND_CLEAN} {_ISSUES_SQL})) AS clean_issues
    FROM sizes""",
)
def cleaning_report(t):
    found = staged_cleaning(t).report("messy_orders")
    nulls = F.transform(F.array_sort(F.map_entries("nulls_per_column_after")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.select(
        "source_name", "rows_before", "rows_after", "columns_before", "columns_after", "duplicates_removed",
        F.array_join("dropped_columns", "|").alias("dropped_columns"), F.array_join(nulls, "|").alias("nulls_after"),
        "raw_score", "clean_score", F.size("issues").cast("long").alias("issues"), F.size("clean_issues").cast("long").alias("clean_issues"),
    )
