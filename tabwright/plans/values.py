"""Column statistics and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions import names, parse
from tabwright.functions.text import quoted
from tabwright.operators import analyze, anomaly, columns as C, hitters, profile, report, sketches
from tabwright.plans.registry import Tables, register
from tabwright.session import staged
from tabwright.sources.store import catalog

# The schema of the given tables in column order: # marks numbers, @ times, [] lists, the rest is text.
_COLUMNS = {
    "region": "r_regionkey# r_name",
    "nation": "n_nationkey# n_name n_regionkey#",
    "customer": "c_custkey# c_name c_nationkey# c_acctbal# c_mktsegment",
    "supplier": "s_suppkey# s_name s_nationkey# s_acctbal#",
    "part": "p_partkey# p_name p_brand p_type p_size# p_retailprice#",
    "orders": "o_orderkey# o_custkey# o_orderstatus o_totalprice# o_orderdate@ o_orderpriority",
    "lineitem": "l_orderkey# l_partkey# l_suppkey# l_linenumber# l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate@",
    "events": "event_id# ts@ user_id# event_type value# props",
    "documents": "doc_id# text lang source n_chars#",
    "embeddings": "vec_id# embedding[] label#",
    "pages": "page_id# url html",
    "benchmark": "item_id# text",
    "labels": "doc_id# quality# toxic#",
    "conversations": "conv_id# turn# role text",
}
_KINDS = {"#": "number", "@": "date", "]": "list"}
SCHEMA = {t: [(c.rstrip("#@[]"), _KINDS.get(c[-1], "text")) for c in cols.split()] for t, cols in _COLUMNS.items()}
EVERY_TABLE = list(SCHEMA)


def each(template: str, columns: list[str]) -> str:
    """The same SELECT for several columns, stacked; {c} is the column, {i} its position."""
    return "\nUNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- per-column statistics -----------------------------------------------------------

LABELLED = ["doc_id", "lang", "source", "quality", "toxic"]
_LABELLED_SQL = """WITH d AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def labelled_documents(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(*LABELLED)


@register(
    "agg_null_stats",
    _LABELLED_SQL
    + each(
        """SELECT '{c}' AS attribute, {i}::INTEGER AS position, count(*) AS row_count, count(*) - count({c}) AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_pct, round(count({c}) / count(*), 6) AS completeness FROM d""",
        LABELLED,
    ),
)
def agg_null_stats(t):
    return rounded(profile.null_stats(labelled_documents(t)), 6, "completeness")


LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
LINE_NUMBERS = LINE_COLUMNS[:8]
LINE_MEASURES = LINE_COLUMNS[4:8]


@register(
    "agg_distinct",
    each("SELECT '{c}' AS attribute, count(DISTINCT {c}) AS distinct_count FROM lineitem", LINE_COLUMNS),
)
def agg_distinct(t):
    return profile.distinct(t.lineitem)


@register(
    "agg_distinct_approx",
    each("SELECT '{c}' AS attribute, count(DISTINCT {c}) AS distinct_count, true AS within_bound FROM lineitem", LINE_COLUMNS),
)
def agg_distinct_approx(t):
    """The sketch's count beside the exact one: within three of its standard errors (5%)."""
    sketch = profile.distinct(t.lineitem, approximate=True).withColumnRenamed("distinct_count", "sketched")
    near = F.abs(F.col("sketched") - F.col("distinct_count")) <= 0.15 * F.col("distinct_count")
    return profile.distinct(t.lineitem).join(sketch, "attribute").select("attribute", "distinct_count", near.alias("within_bound"))


@register(
    "agg_sketched_parts",
    each(
        """SELECT '{c}' AS attribute, count(*) AS row_count, count({c}) AS n, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, true AS distinct_within, true AS median_within FROM lineitem""",
        LINE_NUMBERS,
    )
    + "\nUNION ALL "
    + each(
        """SELECT '{c}', count(*), count({c}), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, true, NULL::BOOLEAN FROM lineitem""",
        LINE_COLUMNS[8:],
    ),
)
def agg_sketched_parts(t):
    """Sketches of three parts, merged, beside the whole table: moments exact, the rest within the stated bounds."""
    third = F.pmod(F.xxhash64("l_orderkey"), F.lit(3))
    parts = [sketches.sketch_table(t.lineitem.filter(third == i)) for i in range(3)]
    stored = staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "sketches")
    merged = staged(sketches.read_sketches(sketches.merge_sketches(stored)), "sketched")
    distinct = profile.distinct(t.lineitem).withColumnRenamed("distinct_count", "exact")
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    distinct = merged.join(distinct, "attribute").select("attribute", (off <= 4 * sketches.DISTINCT_ERROR * F.col("exact")).alias("distinct_within"))
    medians = merged.select("attribute", F.col("quantiles")[1].alias("m"))
    ranks = C.long_numbers(t.lineitem, LINE_NUMBERS).join(medians, "attribute").groupBy("attribute").agg(
        (F.count_if(F.col("value") < F.col("m")) / F.count("*")).alias("below"), (F.count_if(F.col("value") <= F.col("m")) / F.count("*")).alias("upto")
    )
    within = (F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)
    out = merged.join(distinct, "attribute").join(ranks.select("attribute", within.alias("median_within")), "attribute", "left")
    out = out.select("attribute", F.col("rows").alias("row_count"), "n", "low", "high", "mean", "std", "distinct_within", "median_within")
    return rounded(out, 4, "mean", "std")


_SUMMARY_SQL = """SELECT '{c}' AS attribute, {i}::INTEGER AS position, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem"""


@register("agg_numeric_summary", each(_SUMMARY_SQL, LINE_MEASURES))
def agg_numeric_summary(t):
    summary = profile.numeric_summary(t.lineitem, LINE_MEASURES)
    return rounded(rounded(summary, 4, "mean", "std"), 6, "p25", "median", "p75")


@register(
    "agg_shape",
    each(
        """SELECT '{c}' AS attribute, {i}::INTEGER AS position, count({c}) AS n, round(var_samp({c}), 4) AS variance,
  round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem""",
        LINE_MEASURES,
    ),
)
def agg_shape(t):
    return rounded(rounded(analyze.shape(t.lineitem, LINE_MEASURES), 4, "variance"), 6, "skewness", "kurtosis")


def pair_sql(columns: list[str], table: str, digits: int) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), {digits}) AS correlation FROM {table}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


@register(
    "agg_corr_pairs",
    f"SELECT * FROM ({pair_sql(LINE_NUMBERS, 'lineitem', 4)}) ORDER BY abs(correlation) DESC, col1, col2 LIMIT 10",
)
def agg_corr_pairs(t):
    return analyze.strongest_pairs(t.lineitem, LINE_NUMBERS)


ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@register(
    "agg_top_values",
    each(
        """SELECT '{c}' AS attribute, rank::INTEGER AS rank, value, n FROM (
  SELECT {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
  FROM orders GROUP BY {c}) WHERE rank <= 5""",
        ORDER_FIELDS,
    ),
)
def agg_top_values(t):
    counts = C.value_counts(t.orders, ORDER_FIELDS)
    return C.top_values(counts, 5).select("attribute", "rank", "value", "n")


LINE_FIELDS = ["l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]


@register(
    "agg_top_values_proven",
    each(
        """SELECT '{c}' AS attribute, rank::INTEGER AS rank, value, n FROM (
  SELECT replace(regexp_replace({c}::VARCHAR, '[.]0$', ''), ' 00:00:00', '') AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
  FROM lineitem GROUP BY {c}) WHERE rank <= 5""",
        LINE_FIELDS,
    ),
)
def agg_top_values_proven(t):
    """The same by a summary and an exact second pass; columns without clear leaders are counted in full."""
    top, _ = hitters.top_values(t.lineitem, LINE_FIELDS, 5)
    shown = F.replace(F.regexp_replace("value", "[.]0$", ""), F.lit(" 00:00:00"), F.lit(""))
    return top.select("attribute", "rank", shown.alias("value"), "n")


EVENT_FIELDS = ["user_id", "event_type", "value"]


@register(
    "agg_mode",
    each(
        """SELECT '{c}' AS attribute, mode FROM (
  SELECT {c}::VARCHAR AS mode, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM events GROUP BY {c}) WHERE rank = 1""",
        EVENT_FIELDS,
    ),
)
def agg_mode(t):
    return C.modes(C.value_counts(t.events, EVENT_FIELDS))


@register(
    "agg_duplicates",
    """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows
       FROM documents""",
)
def agg_duplicates(t):
    return C.duplicate_rows(t.documents.select("text", "lang"))


_SPEND = """WITH spend AS (SELECT o_custkey, count(*) AS orders_placed, round(sum(o_totalprice), 2) AS total_spent
  FROM orders GROUP BY o_custkey)
"""


@register(
    "describe_result",
    _SPEND
    + each(
        """SELECT '{c}' AS attribute, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
  round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM spend""",
        ["o_custkey", "orders_placed", "total_spent"],
    ),
)
def describe_result(t):
    spend = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("orders_placed"), F.round(F.sum("o_totalprice"), 2).alias("total_spent")
    )
    return rounded(report.describe_result(spend), 4, "mean", "std", "p25", "median", "p75")


@register(
    "distinct_values",
    each(
        """SELECT '{c}' AS attribute, value FROM (
  SELECT {c}::VARCHAR AS value, row_number() OVER (ORDER BY {c}) AS rank, count(*) OVER () AS n FROM orders GROUP BY {c})
  WHERE rank <= CASE WHEN n <= 20 THEN 20 ELSE 5 END""",
        ORDER_FIELDS,
    ),
)
def distinct_values(t):
    shown = profile.profile_table(t.orders.select(*ORDER_FIELDS))
    return shown.select("attribute", F.explode("sample_values").alias("value"))


@register("drop_duplicates", "SELECT DISTINCT text, lang, n_chars FROM documents")
def drop_duplicates(t):
    return t.documents.select("text", "lang", "n_chars").dropDuplicates()


# --- scalar functions -------------------------------------------------------------------


@register(
    "fn_trim",
    r"""SELECT conv_id, turn, regexp_replace(chr(9) || '  ' || text || '  ' || chr(10), '^\s+|\s+$', '', 'g') AS text
        FROM conversations""",
)
def fn_trim(t):
    padded = F.concat(F.lit("\t  "), F.col("text"), F.lit("  \n"))
    return t.conversations.withColumn("text", padded).selectExpr("conv_id", "turn", f"{parse.strip('text')} AS text")


_IDENTIFIER_SQL = r"lower(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g'))"


@register(
    "fn_identifier",
    f"""SELECT raw, CASE WHEN s = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'col_' || s ELSE s END AS clean FROM (
        SELECT raw, {_IDENTIFIER_SQL.format(x='raw')} AS s FROM (
          SELECT DISTINCT p_size || ' (' || p_brand || ') ' || p_name || '!' AS raw FROM part
          UNION SELECT DISTINCT ' ' || p_type || '--' || p_brand FROM part))""",
)
def fn_identifier(t):
    first = F.concat(F.col("p_size").cast("string"), F.lit(" ("), "p_brand", F.lit(") "), "p_name", F.lit("!"))
    second = F.concat(F.lit(" "), "p_type", F.lit("--"), "p_brand")
    raw = t.part.select(F.explode(F.array(first, second)).alias("raw")).distinct()
    return raw.select("raw", names.identifier(F.col("raw")).alias("clean"))


_FILE_SQL = "regexp_extract(url, '[^/]*$')"


@register(
    "fn_table_name",
    f"""SELECT CASE WHEN s = '' THEN 'uploaded_table' WHEN regexp_matches(s, '^[0-9]') THEN 'tbl_' || s ELSE s END AS table_name,
        count(*) AS files FROM (SELECT {_IDENTIFIER_SQL.format(x=f"regexp_replace({_FILE_SQL}, '[.][^.]*$', '')")} AS s FROM pages)
        GROUP BY 1""",
)
def fn_table_name(t):
    file = F.regexp_extract("url", "[^/]*$", 0)
    return t.pages.groupBy(names.table_identifier(file).alias("table_name")).agg(F.count("*").alias("files"))


_FREE_SQL = _IDENTIFIER_SQL.format(x=f"regexp_replace(regexp_replace({_FILE_SQL}, '[0-9]+', '', 'g'), '[.][^.]*$', '')")


@register(
    "fn_table_name_free",
    f"""WITH b AS (SELECT page_id, CASE WHEN s = '' THEN 'uploaded_table' WHEN regexp_matches(s, '^[0-9]') THEN 'tbl_' || s ELSE s END AS base
          FROM (SELECT page_id, {_FREE_SQL} AS s FROM pages)),
        taken AS (SELECT DISTINCT base FROM b WHERE page_id % 7 = 0),
        n AS (SELECT page_id, b.base, row_number() OVER (PARTITION BY b.base ORDER BY page_id) + (t.base IS NOT NULL)::INT AS s
          FROM b LEFT JOIN taken t ON t.base = b.base)
        SELECT page_id, CASE WHEN s = 1 THEN base ELSE base || '_' || s END AS table_name FROM n""",
)
def fn_table_name_free(t):
    """A table name of its own for the file behind each page (numbers left out), beside raw tables that exist already."""
    file = F.regexp_replace(F.regexp_extract("url", "[^/]*$", 0), r"\d+", "")
    files = t.pages.select("page_id", file.alias("file"))
    existing = files.filter("page_id % 7 = 0").select(F.concat(names.table_identifier(F.col("file")), F.lit("__raw")).alias("table_name")).distinct()
    return names.free_table_names(files, "file", existing, ["page_id"]).select("page_id", "table_name")


@register("fn_dedupe_names")
def fn_dedupe_names(t):
    """All columns of all tables side by side, as one wide file would hold them."""
    found = catalog({n: getattr(t, n) for n in EVERY_TABLE})
    raw = [(n, i, c) for n in EVERY_TABLE for i, c in enumerate(getattr(t, n).columns)]
    clean = names.unique_names(c for _, _, c in raw)
    pairs = F.create_map(*[F.lit(x) for (n, i, _), c in zip(raw, clean) for x in (f"{n}/{i}", c)])
    return found.withColumn("clean_name", pairs[F.concat_ws("/", "table_name", F.col("position").cast("string"))])


@register(
    "fn_parse_bool",
    """SELECT o_orderkey, CASE lower(trim(w)) WHEN 'yes' THEN true WHEN 'n' THEN false END AS flag FROM (
         SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Yes ' WHEN 'O' THEN 'N' ELSE 'perhaps' END AS w FROM orders)""",
)
def fn_parse_bool(t):
    word = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "N").otherwise("perhaps")
    words = t.orders.select("o_orderkey", word.alias("word"))
    return words.selectExpr("o_orderkey", f"{parse.read_bool('word')} AS flag")


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


MONEY_SQL = "'$' || format('{:,.2f}', o_totalprice)"


@register(
    "fn_parse_currency",
    f"""SELECT o_orderkey, regexp_matches(m, '^[$€£₹¥]?\\s*[0-9,]+\\.?[0-9]*$') AS is_currency,
        TRY_CAST(regexp_replace(m, '[$€£₹¥,\\s]', '', 'g') AS DOUBLE) AS amount FROM (
          SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n.a. ' || {MONEY_SQL} ELSE {MONEY_SQL} END AS m FROM orders)""",
)
def fn_parse_currency(t):
    money = money_text(F.col("o_totalprice"))
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("n.a. "), money)).otherwise(money)
    return t.orders.select("o_orderkey", text.alias("money")).selectExpr(
        "o_orderkey", f"{parse.is_currency('money')} AS is_currency", f"{parse.read_currency('money')} AS amount"
    )


def mixed_date_text(day: Column, kind: Column) -> Column:
    """The same dates in five spellings, one of them not a date."""
    year, month, dom = F.year(day), F.month(day), F.dayofmonth(day)
    iso = day.cast("date").cast("string")
    return (
        F.when(kind == "1-URGENT", iso)
        .when(kind == "2-HIGH", F.concat_ws("/", month, dom, year))
        .when(kind == "3-MEDIUM", F.concat_ws("-", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)))
        .when(kind == "4-NOT SPECIFIED", F.replace(iso, F.lit("-"), F.lit("/")))
        .otherwise(F.concat(F.lit("about "), iso))
    )


MIXED_DATE_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN '2-HIGH' THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
  WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d-%m-%Y')
  WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y/%m/%d')
  ELSE 'about ' || strftime(o_orderdate, '%Y-%m-%d') END"""
READ_DATE_SQL = "try_strptime({x}, ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%m-%d-%Y', '%d-%m-%Y', '%Y/%m/%d'])"


@register(
    "fn_parse_date",
    f"SELECT o_orderkey, s AS raw, {READ_DATE_SQL.format(x='s')}::VARCHAR AS read FROM (SELECT o_orderkey, {MIXED_DATE_SQL} AS s FROM orders)",
)
def fn_parse_date(t):
    raw = mixed_date_text(F.col("o_orderdate"), F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", raw.alias("raw"))
    return rows.selectExpr("*", f"string({parse.read_date('raw')}) AS read")


#: Spelling, in Spark's and in DuckDB's patterns, and the seconds it shows beyond the day.
_SPELLINGS = [
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", 52_327, 0),
    ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%dT%H:%M:%S+02:00", 52_327, -7_200),
    ("MMM d, yyyy", "%b %-d, %Y", 0, 0),
    ("d MMMM yyyy", "%-d %B %Y", 0, 0),
    ("yyyyMMdd", "%Y%m%d", 0, 0),
    ("MM/dd/yy", "%m/%d/%y", 0, 0),
    ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M", 52_320, 0),
    ("M/d/yyyy hh:mm:ss a", "%-m/%-d/%Y %I:%M:%S %p", 52_327, 0),
    ("EEE, dd MMM yyyy HH:mm:ss", "%a, %d %b %Y %H:%M:%S", 52_327, 0),
]


def _per_spelling(branch) -> str:
    cases = " ".join(f"WHEN {i} THEN {branch(*s)}" for i, s in enumerate(_SPELLINGS))
    return f"CASE o_custkey % {len(_SPELLINGS)} {cases} END"


@register(
    "fn_parse_date_spellings",
    f"""WITH d AS (SELECT o_orderkey, o_custkey, date_trunc('day', o_orderdate) AS day FROM orders)
    SELECT o_orderkey, {_per_spelling(lambda _, p, shown, off: f"strftime(day + INTERVAL {shown} SECOND, '{p}')")} AS raw,
      (day + INTERVAL 1 SECOND * {_per_spelling(lambda _, p, shown, off: shown + off)})::VARCHAR AS read FROM d""",
)
def fn_parse_date_spellings(t):
    """Every order's day in one of nine spellings of exports and logs, read back."""
    day = t.orders.selectExpr("o_orderkey", "o_custkey", "CAST(date(o_orderdate) AS TIMESTAMP_NTZ) AS day")
    text = _per_spelling(
        lambda p, _, shown, off: f"date_format(day + INTERVAL '{shown}' SECOND, {quoted(p)})"
    )
    return day.selectExpr("o_orderkey", f"{text} AS raw").selectExpr("*", f"string({parse.read_date('raw')}) AS read")


@register(
    "fn_epoch_detect",
    """WITH e AS (SELECT epoch(ts)::BIGINT AS seconds, epoch_ms(ts) AS millis, event_id FROM events)
       SELECT a AS attribute, CASE WHEN lo >= 946684800 AND hi <= 2147483647 THEN 's'
              WHEN lo >= 946684800000 AND hi <= 2147483647000 THEN 'ms' END AS unit FROM (
         SELECT 'seconds' AS a, min(seconds) AS lo, max(seconds) AS hi FROM e
         UNION ALL SELECT 'millis', min(millis), max(millis) FROM e
         UNION ALL SELECT 'event_id', min(event_id), max(event_id) FROM e)""",
)
def fn_epoch_detect(t):
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    times = t.events.select(
        F.timestamp_diff("SECOND", start, "ts").alias("seconds"),
        F.timestamp_diff("MILLISECOND", start, "ts").alias("millis"),
        "event_id",
    )
    units = C.per_column(times, times.columns, lambda c: {"unit": parse.epoch_unit(f"min({c})", f"max({c})")})
    return units.drop("position")


@register(
    "fn_coerce_numeric",
    f"""SELECT page_id, TRY_CAST({_FILE_SQL} AS DOUBLE) AS number, coalesce(TRY_CAST({_FILE_SQL} AS DOUBLE), 0.0)::DOUBLE AS filled
        FROM pages""",
)
def fn_coerce_numeric(t):
    last = t.pages.select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("last"))
    read = last.selectExpr("page_id", f"{parse.read_number('last')} AS number")
    return read.selectExpr("*", "coalesce(number, 0D) AS filled")


@register(
    "fn_impute_median",
    _LABELLED_SQL
    + "SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM d))::DOUBLE AS quality FROM d",
)
def fn_impute_median(t):
    filled = anomaly.impute_median(labelled_documents(t), ["quality"])
    return filled.select("doc_id", "quality")


@register(
    "fn_date_trunc",
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarter,
              date_trunc('week', o_orderdate)::DATE::VARCHAR || '/' || (date_trunc('week', o_orderdate)::DATE + 6)::VARCHAR AS week,
              year(o_orderdate)::INTEGER AS year FROM orders""",
)
def fn_date_trunc(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.trunc(day, "month").cast("string").alias("month"),
        F.trunc(day, "quarter").cast("string").alias("quarter"),
        analyze.week_label(F.col("o_orderdate")).alias("week"),
        F.year(day).alias("year"),
    )


@register(
    "fn_iso",
    """SELECT event_id, replace(ts::VARCHAR, ' ', 'T') AS ts_text, CASE WHEN value >= 50 THEN round(sqrt(value - 50), 6) END AS root FROM events""",
)
def fn_iso(t):
    root = parse.nan_to_null("sqrt(value - 50)")
    ts_type = dict(t.events.dtypes)["ts"]
    return t.events.selectExpr("event_id", f"{parse.iso_text('ts', ts_type)} AS ts_text", f"round({root}, 6) AS root")


@register(
    "fn_truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END AS text FROM documents",
)
def fn_truncate_text(t):
    return t.documents.selectExpr("doc_id", f"{parse.shorten('text')} AS text")


@register(
    "fn_round",
    """SELECT l_quantity, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2, 0) AS half_up, count(*) AS n
       FROM lineitem GROUP BY l_quantity""",
)
def fn_round(t):
    half = F.col("l_quantity") / 2
    groups = t.lineitem.groupBy("l_quantity").agg(F.count("*").alias("n"))
    return groups.select("l_quantity", F.bround(half, 0).alias("half_even"), F.round(half, 0).alias("half_up"), "n")


@register(
    "fn_format",
    """SELECT o_orderpriority, format('{:,}', count(*)) AS n_text, format('{:,.2f}', round(sum(o_totalprice), 2)) AS total_text,
              printf('%.1f%%', 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)) AS pct_text,
              printf('%+.2f', round(avg(o_totalprice) / 250000 - 1, 6)) AS signed_text FROM orders GROUP BY o_orderpriority""",
)
def fn_format(t):
    pct = F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count("*")
    offset = F.round(F.avg("o_totalprice") / 250000 - 1, 6)
    return t.orders.groupBy("o_orderpriority").agg(
        F.format_number(F.count("*"), 0).alias("n_text"),
        F.format_number(F.round(F.sum("o_totalprice"), 2), 2).alias("total_text"),
        F.concat(F.format_number(pct, 1), F.lit("%")).alias("pct_text"),
        F.concat(F.when(offset < 0, "").otherwise("+"), F.format_number(offset, 2)).alias("signed_text"),
    )


# --- closest names ------------------------------------------------------------------------

#: Common subsequence of two words, letter by letter, as nested folds over lists of numbers.
_COMMON_SQL = """list_reduce([list_transform(range(length(name) + 1), lambda x: 0::BIGINT)] || list_transform(string_split(requested, ''), lambda c: [ord(c)::BIGINT]),
  lambda row, letter: list_reduce([[0::BIGINT]] || list_transform(range(1, length(name) + 1), lambda j: [j]),
    lambda done, j: done || [CASE WHEN ord(name[j[1]]) = letter[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], done[-1]) END]))[-1]"""


@register(
    "fuzzy_name_match",
    f"""WITH words AS (SELECT DISTINCT unnest(string_split(lower(p_type || ' ' || p_name || ' ' || p_brand), ' ')) AS requested FROM part),
            known AS (SELECT unnest(['promotion', 'standards', 'widgets', 'brand', 'medium_size', 'gizmos', 'economic', 'plates', 'hot', 'older']) AS name),
            scored AS (SELECT requested, name, 200.0 * ({_COMMON_SQL})::DOUBLE / (length(requested) + length(name)) AS score FROM words, known WHERE requested <> ''),
            best AS (SELECT requested, name, score, row_number() OVER (PARTITION BY requested ORDER BY score DESC, name) AS rn FROM scored)
       SELECT requested, CASE WHEN score >= 60 THEN name ELSE 'unknown' END AS matched FROM best WHERE rn = 1""",
)
def fuzzy_name_match(t):
    known = ["promotion", "standards", "widgets", "brand", "medium_size", "gizmos", "economic", "plates", "hot", "older"]
    text = F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    words = t.part.select(F.explode(F.split(text, " ")).alias("requested")).filter("requested <> ''").distinct()
    return words.select("requested", names.closest_name(F.col("requested"), known, "unknown").alias("matched"))
