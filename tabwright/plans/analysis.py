"""Profiles, analyses, domain measures, chart data and anomalies over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators import activity, analyze, anomaly, charts, columns as C, forest, kpis, profile
from tabwright.plans.registry import Tables, register
from tabwright.plans.values import LABELLED, LINE_MEASURES, SCHEMA, each, labelled_documents, pair_sql, rounded
from tabwright.session import staged

# --- profiles -----------------------------------------------------------------------------

ORDER_COLUMNS = [
    ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"), ("o_orderstatus", "string", "text"),
    ("o_totalprice", "double", "number"), ("o_orderdate", "timestamp_ntz", "date"),
    ("o_orderpriority", "string", "text"),
]


def _profile_sql(i: int, c: str, dtype: str, kind: str) -> str:
    number, shown = kind == "number", kind != "text"
    stat = lambda sql: sql if number else "NULL::DOUBLE"
    edge = lambda f: f"replace({f}({c})::VARCHAR, ' ', 'T')" if shown else "NULL::VARCHAR"
    top = (
        f"""(SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM orders
             WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""
        if not number
        else "''"
    )
    return f"""SELECT '{c}' AS attribute, {i}::INTEGER AS position, '{dtype}' AS dtype, count(*) AS row_count,
  round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_pct, count(DISTINCT {c}) AS distinct_count,
  {edge('min')} AS min, {edge('max')} AS max, {stat(f'round(avg({c}), 4)')} AS mean,
  {stat(f'round(quantile_cont({c}, 0.5), 4)')} AS median, {stat(f'round(coalesce(stddev_samp({c}), 0), 4)')} AS std,
  {stat(f'round(quantile_cont({c}, 0.25), 4)')} AS p25, {stat(f'round(quantile_cont({c}, 0.75), 4)')} AS p75,
  (SELECT string_agg(v::VARCHAR, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL ORDER BY v
     LIMIT (SELECT CASE WHEN count(DISTINCT {c}) <= 20 THEN 20 ELSE 5 END FROM orders))) AS sample_values,
  {top} AS top_5, count(DISTINCT {c}) / count(*) >= 0.95 AS is_candidate_id, count(DISTINCT {c}) <= 1 AS is_constant FROM orders"""


@register("profile_table", "\nUNION ALL ".join(_profile_sql(i, *c) for i, c in enumerate(ORDER_COLUMNS)))
def profile_table(t):
    top = F.transform("top_5", lambda s: F.concat_ws(":", s["value"], s["n"].cast("string")))
    shown = profile.profile_table(t.orders).withColumns(
        {"sample_values": F.array_join("sample_values", "|"), "top_5": F.array_join(top, "|")}
    )
    return rounded(shown, 4, "median", "p25", "p75")


# Lists have no role.
ROLE_TABLES = {t: [(c, kind) for c, kind in cols if kind != "list"] for t, cols in SCHEMA.items()}
_LOOKS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|^[0-9]{4}/[0-9]{2}/[0-9]{2}"
_PAIRS = [
    ("true", "false"), ("0", "1"), ("0.0", "1.0"), ("yes", "no"), ("y", "n"), ("active", "inactive"), ("t", "f"),
]


def _role_sql(table: str, i: int, c: str, kind: str) -> str:
    is_id = c.endswith("_id") or c == "id"
    if kind == "date":
        is_date, is_bool = "true", "false"
    elif kind == "number":
        is_date = (
            f"(min({c}) >= 946684800 AND max({c}) <= 2147483647) OR (min({c}) >= 946684800000 AND max({c}) <= 2147483647000)"
        )
        is_bool = f"bool_and({c} IN (0, 1))"
    else:
        is_date = f"count(*) FILTER (WHERE regexp_matches(trim({c}), '{_LOOKS}')) >= 0.7 * count({c})"
        is_bool = " OR ".join(f"bool_and(lower(trim({c})) IN {p})" for p in _PAIRS)
    length = f"avg(length({c}))" if kind == "text" else "0"
    return f"""SELECT '{table}' AS table_name, '{c}' AS attribute, {i}::INTEGER AS position, row_count, missing_pct, distinct_count,
  is_date AS is_datetime, is_bool AS is_boolean,
  CASE WHEN {is_id} AND distinct_count >= least(5, floor(0.3 * row_count)) THEN 'id' WHEN is_date THEN 'datetime' WHEN is_bool THEN 'boolean'
    WHEN {kind == 'number'} THEN 'numeric' WHEN distinct_count / row_count >= 0.85 AND row_count > 10 THEN 'id'
    WHEN {kind == 'text'} AND distinct_count / row_count > 0.5 AND mean_length > 25 THEN 'text' ELSE 'categorical' END AS role
  FROM (SELECT count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS missing_pct,
    count(DISTINCT {c}) AS distinct_count, coalesce({is_date}, false) AS is_date, coalesce({is_bool}, false) AS is_bool, {length} AS mean_length FROM {table})"""


ROLES_SQL = "\nUNION ALL ".join(
    _role_sql(table, i, c, kind) for table, cols in ROLE_TABLES.items() for i, (c, kind) in enumerate(cols)
)


def all_roles(t: Tables) -> DataFrame:
    result = None
    for table in ROLE_TABLES:
        part = profile.profile_roles(getattr(t, table)).select(F.lit(table).alias("table_name"), "*")
        result = part if result is None else result.unionByName(part)
    return result


@register(
    "profile_roles",
    f"SELECT table_name, attribute, position, row_count, missing_pct, distinct_count, role FROM ({ROLES_SQL})",
)
def profile_roles(t):
    return all_roles(t).drop("dtype")


def _evidence(t: Tables, name: str) -> DataFrame:
    result = None
    for table in ROLE_TABLES:
        part = profile.role_evidence(getattr(t, table)).select(F.lit(table).alias("table_name"), "attribute", name)
        result = part if result is None else result.unionByName(part)
    return result


@register("detect_datetime_cols", f"SELECT table_name, attribute, is_datetime FROM ({ROLES_SQL})")
def detect_datetime_cols(t):
    return _evidence(t, "is_datetime")


@register("detect_boolean_cols", f"SELECT table_name, attribute, is_boolean FROM ({ROLES_SQL})")
def detect_boolean_cols(t):
    return _evidence(t, "is_boolean")


_V1_COLUMNS = ["text", "lang", "quality", "toxic"]
_V1_FROM = "WITH d AS (SELECT d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@register(
    "quality_score_v1",
    f"""{_V1_FROM}, miss AS ({each("SELECT round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS pct FROM d", _V1_COLUMNS)}),
    c AS (SELECT avg(pct) AS avg_missing_pct, count(*) FILTER (WHERE pct >= 60) AS mostly_missing_columns FROM miss),
    r AS (SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM d)
    SELECT row_count, duplicate_rows, round(duplicate_rows * 100.0 / row_count, 6)::DOUBLE AS duplicate_pct,
      round(avg_missing_pct, 6) AS avg_missing_pct, mostly_missing_columns,
      greatest(0.0, least(100.0, round(100 - avg_missing_pct * 0.4 - duplicate_rows * 100.0 / row_count * 0.3 - mostly_missing_columns * 3, 1)))::DOUBLE AS score
    FROM r, c""",
)
def quality_score_v1(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(*_V1_COLUMNS)
    return rounded(profile.quality_score_v1(rows), 6, "duplicate_pct", "avg_missing_pct")


@register(
    "profile_samples",
    each(
        """SELECT '{c}' AS attribute, rank::INTEGER AS rank, value FROM (
  SELECT {c}::VARCHAR AS value, row_number() OVER (ORDER BY {c}) AS rank FROM orders GROUP BY {c}) WHERE rank <= 3""",
        [c for c, _, _ in ORDER_COLUMNS],
    ),
)
def profile_samples(t):
    return profile.profile_samples(t.orders)


# --- analyses --------------------------------------------------------------------------------


@register(
    "an_descriptive",
    f"""WITH s AS ({each("SELECT '{c}' AS attribute, {i} AS position, var_samp({c}) AS variance, abs(skewness({c})) AS skew FROM lineitem", LINE_MEASURES)}),
    lead AS (SELECT max_by(attribute, (variance, -position)) AS highest_variance, max_by(attribute, (skew, -position)) AS most_skewed FROM s),
    t AS ({each('''SELECT '{c}' AS attribute, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
      round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem''', LINE_MEASURES)})
    SELECT t.*, lead.* FROM t, lead""",
)
def an_descriptive(t):
    return analyze.descriptive(t.lineitem, LINE_MEASURES)


_EVENT_NUMBERS = ["event_id", "user_id", "value"]


@register(
    "an_distribution",
    each(
        """SELECT '{c}' AS attribute, round(skewness({c}), 2) AS skewness, round(kurtosis({c}), 2) AS kurtosis,
  CASE WHEN skewness({c}) > 1 THEN 'Strongly Right-Skewed' WHEN skewness({c}) < -1 THEN 'Strongly Left-Skewed'
       ELSE 'Approximately Normal' END AS distribution_class FROM events""",
        _EVENT_NUMBERS,
    ),
)
def an_distribution(t):
    return analyze.distribution(t.events, _EVENT_NUMBERS)


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_MEASURES]


@register(
    "an_distribution_wide",
    each(
        """SELECT '{c}' AS attribute, round(skewness({c}), 2) AS skewness, round(kurtosis({c}), 2) AS kurtosis,
  CASE WHEN skewness({c}) > 1 THEN 'Strongly Right-Skewed' WHEN skewness({c}) < -1 THEN 'Strongly Left-Skewed'
       ELSE 'Approximately Normal' END AS distribution_class FROM lineitem""",
        _LINE_NUMBERS,
    ),
)
def an_distribution_wide(t):
    return analyze.distribution(t.lineitem, _LINE_NUMBERS)


_DOC_NUMBERS = ["n_chars", "quality", "toxic"]
_COMPLETE = "(SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def _document_numbers(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(*_DOC_NUMBERS)


@register("an_correlation", pair_sql(_DOC_NUMBERS, _COMPLETE, 3))
def an_correlation(t):
    return analyze.correlation(_document_numbers(t), _DOC_NUMBERS)


@register(
    "an_correlation_leaders",
    f"""WITH p AS ({pair_sql(_DOC_NUMBERS, _COMPLETE, 3)}),
    ranked AS (SELECT *, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction,
      row_number() OVER (PARTITION BY correlation > 0 ORDER BY abs(correlation) DESC, col1, col2) AS rn FROM p WHERE correlation <> 0)
    SELECT direction, col1, col2, correlation, col1 || ' & ' || col2 || ' (' || printf('%+.2f', correlation) || ')' AS label
    FROM ranked WHERE rn <= 3""",
)
def an_correlation_leaders(t):
    return analyze.correlation_leaders(_document_numbers(t), _DOC_NUMBERS)


_CATEGORIES = ["lang", "source"]


@register(
    "an_value_frequency",
    each(
        """SELECT '{c}' AS attribute, count(*) AS unique_classes, min_by(v, (-n, v)) AS dominant_class, max(n) AS dominant_count,
  round(max(n) * 100.0 / (SELECT count(*) FROM documents), 1)::DOUBLE AS dominant_share_pct
  FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c})""",
        _CATEGORIES,
    ),
)
def an_value_frequency(t):
    return analyze.value_frequency(t.documents, _CATEGORIES)


_LINE_CLASSES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register(
    "an_value_frequency_wide",
    each(
        """SELECT '{c}' AS attribute, count(*) AS unique_classes, min_by(v, (-n, v)) AS dominant_class, max(n) AS dominant_count,
  round(max(n) * 100.0 / (SELECT count(*) FROM lineitem), 1)::DOUBLE AS dominant_share_pct
  FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})""",
        _LINE_CLASSES,
    ),
)
def an_value_frequency_wide(t):
    return analyze.value_frequency(t.lineitem, _LINE_CLASSES)


_MONTHS_SQL = """SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS total_value,
  round(avg(o_totalprice), 4) AS average_value, count(*) AS record_count FROM orders GROUP BY 1"""
_WEEKS_SQL = """SELECT date_trunc('week', ts)::DATE::VARCHAR || '/' || (date_trunc('week', ts)::DATE + 6)::VARCHAR AS period,
  round(sum(value), 2) AS total_value, round(avg(value), 4) AS average_value, count(*) AS record_count FROM events GROUP BY 1"""


def _shown(trend: DataFrame) -> DataFrame:
    return rounded(rounded(trend, 2, "total_value"), 4, "average_value")


@register("an_time_trend", _MONTHS_SQL)
def an_time_trend(t):
    return _shown(analyze.time_trend(t.orders, "o_orderdate", "o_totalprice"))


@register("an_time_trend_weekly", _WEEKS_SQL)
def an_time_trend_weekly(t):
    return _shown(analyze.time_trend(t.events, "ts", "value"))


@register("t_last_n_periods", f"SELECT * FROM ({_MONTHS_SQL}) ORDER BY period DESC LIMIT 12")
def t_last_n_periods(t):
    return analyze.last_periods(_shown(analyze.time_trend(t.orders, "o_orderdate", "o_totalprice")))


@register(
    "t_peak_low",
    f"""SELECT min_by(period, (-record_count, period)) AS peak_period, max(record_count) AS peak_count,
        min_by(period, (record_count, period)) AS lowest_period, min(record_count) AS lowest_count, count(*) AS periods FROM ({_MONTHS_SQL})""",
)
def t_peak_low(t):
    return analyze.peak_and_low(analyze.time_trend(t.orders, "o_orderdate"))


_COMPARED_SQL = """SELECT c_mktsegment AS group_value, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY mean DESC, group_value LIMIT 10"""


def _compared(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return analyze.group_comparison(rows, "c_mktsegment", "o_totalprice")


@register("an_group_comparison", _COMPARED_SQL)
def an_group_comparison(t):
    return rounded(_compared(t), 4, "mean", "median", "std")


@register(
    "an_group_extremes",
    f"""SELECT min_by(group_value, (-mean, group_value)) AS best_group, max(mean) AS best_value,
        max_by(group_value, (-mean, group_value)) AS worst_group, min(mean) AS worst_value FROM ({_COMPARED_SQL})""",
)
def an_group_extremes(t):
    return rounded(analyze.group_extremes(_compared(t)), 4, "best_value", "worst_value")


@register(
    "an_status_breakdown",
    _V1_FROM.replace("d.text, d.lang, ", "")
    + """ SELECT coalesce(quality::VARCHAR, 'nan') AS status_state, count(*) AS n,
          round(count(*) * 100.0 / (SELECT count(*) FROM d), 1)::DOUBLE AS pct FROM d GROUP BY 1""",
)
def an_status_breakdown(t):
    return analyze.status_breakdown(labelled_documents(t), "quality")


_CROSSTAB_SQL = """SELECT row_value, col_value, n, round(n / sum(n) OVER (PARTITION BY row_value), 3) * 100.0 AS pct FROM (
  SELECT source AS row_value, lang AS col_value, count(*) AS n FROM documents GROUP BY 1, 2)"""


@register("an_crosstab", _CROSSTAB_SQL)
def an_crosstab(t):
    return analyze.crosstab(t.documents, "source", "lang")


@register(
    "an_cohort_size",
    "SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
)
def an_cohort_size(t):
    return analyze.last_periods(analyze.cohort_sizes(t.orders, "o_custkey", "o_orderdate"), period="cohort")


@register(
    "an_largest_cohort",
    """SELECT min_by(cohort, (-entities, cohort)) AS largest_cohort, max(entities) AS entities, count(*) AS cohorts FROM (
         SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1)""",
)
def an_largest_cohort(t):
    return analyze.largest_cohort(analyze.cohort_sizes(t.orders, "o_custkey", "o_orderdate"))


_DAYS = (7, 30, 60, 90)


@register(
    "an_cohort_retention",
    """WITH lives AS (SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_custkey),
            c AS (SELECT strftime(first, '%Y-%m') AS cohort, date_diff('day', first, last) AS lasted FROM lives)
       SELECT cohort, count(*) AS entities, """
    + ", ".join(f"count(*) FILTER (WHERE lasted >= {d}) AS retained_d{d}" for d in _DAYS)
    + ", "
    + ", ".join(f"round(count(*) FILTER (WHERE lasted >= {d}) * 100.0 / count(*), 1)::DOUBLE AS d{d}_pct" for d in _DAYS)
    + " FROM c GROUP BY cohort",
)
def an_cohort_retention(t):
    return analyze.cohort_retention(t.orders, "o_custkey", "o_orderdate", _DAYS)


@register(
    "an_entity_aggregation",
    """SELECT count(*) AS unique_entities, count(*) FILTER (WHERE n > 1) AS repeat_entities,
              round(count(*) FILTER (WHERE n > 1) * 100.0 / count(*), 1)::DOUBLE AS repeat_pct
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)""",
)
def an_entity_aggregation(t):
    return analyze.entity_summary(t.orders, "o_custkey")


@register(
    "an_top_entities",
    "SELECT user_id AS entity, count(*) AS activity_count FROM events GROUP BY user_id ORDER BY activity_count DESC, user_id LIMIT 10",
)
def an_top_entities(t):
    return analyze.top_entities(t.events, "user_id")


# --- domain measures --------------------------------------------------------------------------


def _counts_sql(table: str, column: str, k: int | None) -> str:
    limit = f"LIMIT {k}" if k else ""
    return f"SELECT {column} AS category, count(*) AS n FROM {table} GROUP BY {column} ORDER BY n DESC, {column} {limit}"


@register("kpi_hr", _counts_sql("customer", "c_mktsegment", 10))
def kpi_hr(t):
    return kpis.class_counts(t.customer, kpis.pick_column(["c_mktsegment"], kpis.DEPARTMENT_PARTS))


@register("kpi_healthcare", _counts_sql("part", "p_brand", 10))
def kpi_healthcare(t):
    return kpis.class_counts(t.part, kpis.pick_column(["p_brand", "p_type"], kpis.DIAGNOSIS_PARTS))


@register("kpi_marketing", _counts_sql("documents", "source", None))
def kpi_marketing(t):
    return kpis.class_counts(t.documents, kpis.pick_column(["lang", "source"], kpis.CHANNEL_PARTS), k=None)


@register("kpi_education", "SELECT round(avg(n_chars), 2) AS mean_score FROM documents")
def kpi_education(t):
    return kpis.mean_score(t.documents, "n_chars")


@register("kpi_sports", "SELECT max(o_totalprice) AS peak_score FROM orders")
def kpi_sports(t):
    return kpis.peak_score(t.orders, "o_totalprice")


@register("kpi_sensor", "SELECT round(avg(value), 2) AS mean_reading, round(stddev_samp(value), 2) AS std_reading FROM events")
def kpi_sensor(t):
    return kpis.signal_stability(t.events, "value")


@register(
    "kpi_sales",
    """WITH b AS (SELECT o_orderkey AS o, o_custkey AS c, l_partkey::VARCHAR AS p, l_extendedprice AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    po AS (SELECT o, c, sum(a) AS a FROM b GROUP BY o, c), pc AS (SELECT c, count(*) AS n FROM po GROUP BY c),
    pp AS (SELECT p, round(sum(a), 2) AS revenue FROM b GROUP BY p),
    curve AS (SELECT row_number() OVER w AS rank, sum(revenue::DECIMAL(28, 4)) OVER w AS through, count(*) OVER () AS n, sum(revenue::DECIMAL(28, 4)) OVER () AS whole
      FROM pp WINDOW w AS (ORDER BY revenue DESC, p ROWS UNBOUNDED PRECEDING))
    SELECT 'average_order_value' AS metric, '' AS item, round(avg(a), 2) AS value FROM po
    UNION ALL SELECT 'repeat_purchase_pct', '', round(avg(CASE WHEN n > 1 THEN 100.0 ELSE 0.0 END), 2)::DOUBLE FROM pc
    UNION ALL (SELECT 'top_product', p, revenue FROM pp ORDER BY revenue DESC, p LIMIT 5)
    UNION ALL SELECT 'top_20pct_products_revenue_pct', '', round(coalesce(max(CASE WHEN rank * 100.0 / n <= 20 THEN through::DOUBLE * 100.0 / whole::DOUBLE END), 0), 2)::DOUBLE FROM curve""",
)
def kpi_sales(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return kpis.sales(lines, "o_orderkey", "o_custkey", "l_partkey", "l_extendedprice")


_CURVE_SQL = """WITH pp AS (SELECT l_partkey AS item, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_partkey),
    curve AS (SELECT row_number() OVER w AS rank, item, amount, count(*) OVER () AS n, sum(amount::DECIMAL(28, 4)) OVER w AS through,
      sum(amount::DECIMAL(28, 4)) OVER () AS whole FROM pp WINDOW w AS (ORDER BY amount DESC, item ROWS UNBOUNDED PRECEDING))
"""


def revenue_curve(t: Tables) -> DataFrame:
    revenue = t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return kpis.concentration(revenue, "l_partkey", "revenue")


@register(
    "kpi_concentration",
    _CURVE_SQL + """SELECT rank, item, amount, round(rank * 100.0 / n, 6)::DOUBLE AS items_pct,
      round(through::DOUBLE * 100.0 / whole::DOUBLE, 6) AS revenue_pct FROM curve""",
)
def kpi_concentration(t):
    """Every part by falling revenue, with the cumulative shares of parts and revenue."""
    return rounded(revenue_curve(t), 6, "items_pct", "revenue_pct")


@register(
    "kpi_gini",
    _CURVE_SQL + """SELECT count(*) AS items, round((count(*) + 1 - 2 * sum(rank * amount) / sum(amount)) / count(*), 6) AS gini FROM curve""",
)
def kpi_gini(t):
    return rounded(kpis.gini(revenue_curve(t)), 6, "gini")


_AS_OF = "2001-08-01"


@register(
    "kpi_subscription",
    f"""WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS signup, max(o_orderdate)::DATE AS last, round(sum(o_totalprice), 2) AS mrr FROM orders GROUP BY o_custkey),
    a AS (SELECT signup, CASE WHEN last < DATE '{_AS_OF}' - 180 THEN last END AS cancelled, mrr FROM s)
    SELECT count(*) AS accounts, count(cancelled) AS churned, round(avg(CASE WHEN cancelled IS NULL THEN 0.0 ELSE 1.0 END) * 100, 2)::DOUBLE AS churn_pct,
      round(sum(CASE WHEN cancelled IS NULL THEN mrr ELSE 0 END), 2) AS live_mrr, count(*) FILTER (WHERE mrr > 0) AS paid,
      count(*) FILTER (WHERE mrr <= 0) AS unpaid,
      round(avg(date_diff('day', signup, coalesce(cancelled, DATE '{_AS_OF}'))), 2) AS mean_lifetime_days FROM a""",
)
def kpi_subscription(t):
    accounts = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("signup"),
        F.max("o_orderdate").cast("date").alias("last"),
        F.round(F.sum("o_totalprice"), 2).alias("mrr"),
    )
    silent = F.col("last") < F.date_sub(F.lit(_AS_OF).cast("date"), 180)
    accounts = accounts.withColumn("cancelled", F.when(silent, F.col("last")))
    return kpis.subscription(accounts, "signup", "cancelled", "mrr", _AS_OF)


@register(
    "kpi_tenure",
    f"""SELECT floor(date_diff('day', first, DATE '{_AS_OF}') / 365.25)::INTEGER AS tenure_years, count(*) AS entities
        FROM (SELECT o_custkey, min(o_orderdate)::DATE AS first FROM orders GROUP BY o_custkey) GROUP BY 1""",
)
def kpi_tenure(t):
    return kpis.tenure(t.orders, "o_custkey", "o_orderdate", _AS_OF)


@register(
    "kpi_salary_bands",
    """SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6 ELSE floor(c_acctbal / 2000) + 1 END::INTEGER AS band,
              count(*) AS n, round(avg(c_acctbal), 2) AS mean_value, min(c_acctbal) AS low_value, max(c_acctbal) AS high_value
       FROM customer GROUP BY 1""",
)
def kpi_salary_bands(t):
    return kpis.bands(t.customer, "c_acctbal", 0, 10000, 5)


@register(
    "kpi_length_of_stay",
    """SELECT o_orderpriority AS group_value, count(*) AS stays, round(avg(d), 2) AS mean_days, min(d)::INTEGER AS shortest, max(d)::INTEGER AS longest
       FROM (SELECT o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       WHERE d >= 0 GROUP BY 1""",
)
def kpi_length_of_stay(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return kpis.length_of_stay(lines, "o_orderpriority", "o_orderdate", "l_shipdate")


def _rate_sql(source: str, group: str, condition: str, name: str) -> str:
    hits = f"count(*) FILTER (WHERE {condition})"
    return f"""SELECT {group} AS group_value, count(*) AS n, {hits} AS hits, round({hits} * 100.0 / count(*), 2)::DOUBLE AS {name}
               FROM {source} GROUP BY {group}"""


@register("kpi_conversion_rate", _rate_sql("events", "user_id", "event_type = 'purchase'", "conversion_pct"))
def kpi_conversion_rate(t):
    return kpis.rate_by(t.events, "user_id", F.col("event_type") == "purchase", "conversion_pct")


@register("kpi_pass_rate", _rate_sql("documents JOIN labels USING (doc_id)", "lang", "quality = 1", "pass_pct"))
def kpi_pass_rate(t):
    return kpis.rate_by(t.documents.join(t.labels, "doc_id"), "lang", F.col("quality") == 1, "pass_pct")


@register("kpi_win_rate", _rate_sql("orders", "o_orderpriority", "o_orderstatus = 'F'", "win_pct"))
def kpi_win_rate(t):
    return kpis.rate_by(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F", "win_pct")


@register(
    "kpi_spike_share",
    """WITH m AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events)
       SELECT count(*) AS readings, count(*) FILTER (WHERE abs(value - mu) / sd > 2.5) AS spikes,
              round(count(*) FILTER (WHERE abs(value - mu) / sd > 2.5) * 100.0 / count(*), 2)::DOUBLE AS spike_pct FROM events, m""",
)
def kpi_spike_share(t):
    return kpis.spike_share(t.events, "value")


# --- chart data -------------------------------------------------------------------------------


@register(
    "chart_box",
    each(
        """SELECT '{c}' AS attribute, min({c})::DOUBLE AS low, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3, max({c})::DOUBLE AS high FROM lineitem""",
        LINE_MEASURES,
    ),
)
def chart_box(t):
    return rounded(charts.box(t.lineitem, LINE_MEASURES), 4, "q1", "median", "q3")


_BIN = "least(floor((v - lo) * 20 / (hi - lo)) + 1, 20)::INTEGER"


@register(
    "chart_histogram",
    each(
        f"""SELECT '{{c}}' AS attribute, {_BIN} AS bin, count(*) AS n FROM (
  SELECT {{c}}::DOUBLE AS v, min({{c}}) OVER () AS lo, max({{c}}) OVER () AS hi FROM lineitem) GROUP BY 2""",
        LINE_MEASURES,
    ),
)
def chart_histogram(t):
    return charts.histogram(t.lineitem, LINE_MEASURES)


@register(
    "chart_entity_histogram",
    f"""SELECT 'activity_count' AS attribute, {_BIN} AS bin, count(*) AS n FROM (
          SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT count(*)::DOUBLE AS v FROM orders GROUP BY o_custkey)) GROUP BY 2""",
)
def chart_entity_histogram(t):
    return charts.histogram(analyze.entity_counts(t.orders, "o_custkey"), ["activity_count"])


@register(
    "chart_heatmap",
    "SELECT * FROM ("
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS col1, "
        + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({a}, {b}), 4) AS {b}" for b in LINE_MEASURES)
        + " FROM lineitem"
        for a in LINE_MEASURES
    )
    + ")",
)
def chart_heatmap(t):
    return charts.correlation_matrix(analyze.correlation_pairs(t.lineitem, LINE_MEASURES), LINE_MEASURES)


@register(
    "chart_crosstab_heatmap",
    f"""SELECT row_value, sum(CASE WHEN col_value = 'de' THEN pct END) AS de, sum(CASE WHEN col_value = 'en' THEN pct END) AS en,
        sum(CASE WHEN col_value = 'es' THEN pct END) AS es, sum(CASE WHEN col_value = 'fr' THEN pct END) AS fr
        FROM ({_CROSSTAB_SQL}) GROUP BY row_value""",
)
def chart_crosstab_heatmap(t):
    cells = analyze.crosstab(t.documents, "source", "lang")
    return charts.heatmap(cells, "row_value", "col_value", "pct", ["de", "en", "es", "fr"])


_GRID = "least(floor(({x} - min({x}) OVER ()) * 20 / (max({x}) OVER () - min({x}) OVER ())) + 1, 20)::INTEGER"


@register(
    "chart_scatter",
    f"""WITH m AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events),
    z AS (SELECT value, abs((value - mu) / sd) AS score FROM events, m),
    f AS (SELECT *, score >= greatest(2.5, (SELECT quantile_cont(score, 0.95) FROM z)) AS is_anomaly FROM z),
    g AS (SELECT {_GRID.format(x='value')} AS x_bin, {_GRID.format(x='score')} AS y_bin, is_anomaly FROM f)
    SELECT x_bin, y_bin, is_anomaly, count(*) AS n FROM g GROUP BY ALL""",
)
def chart_scatter(t):
    scored = anomaly.zscore(t.events, ["value"])
    return charts.density(scored, "value", "anomaly_score", "is_anomaly")


@register(
    "chart_bar_line_pie",
    f"""SELECT 'bar' AS chart, v AS x, n::DOUBLE AS y FROM (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 10)
        UNION ALL SELECT 'line', period, total_value FROM ({_MONTHS_SQL})
        UNION ALL SELECT 'pie', o_orderstatus, count(*)::DOUBLE FROM orders GROUP BY o_orderstatus""",
)
def chart_bar_line_pie(t):
    def part(chart: str, df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.lit(chart).alias("chart"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))

    bar = part("bar", analyze.top_categories(t.events, ["event_type"]), "value", "n")
    line = part("line", _shown(analyze.time_trend(t.orders, "o_orderdate", "o_totalprice")), "period", "total_value")
    pie = part("pie", analyze.status_breakdown(t.orders, "o_orderstatus"), "status_state", "n")
    return bar.unionByName(line).unionByName(pie)


# --- anomalies --------------------------------------------------------------------------------

_SIGNALS = ["user_id", "value", "k"]


def signals(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.select("event_id", "user_id", "value", k.alias("k"))


_Z_SQL = """WITH s AS (SELECT event_id, user_id, value, (props::JSON->>'$.k')::DOUBLE AS k FROM events),
  m AS (SELECT avg(user_id) AS m1, stddev_samp(user_id) AS s1, avg(value) AS m2, stddev_samp(value) AS s2, avg(k) AS m3, stddev_samp(k) AS s3 FROM s),
  z AS (SELECT s.*, abs(user_id - m1) / s1 AS z1, abs(value - m2) / s2 AS z2, abs(k - m3) / s3 AS z3 FROM s, m),
  g AS (SELECT *, greatest(z1, z2, z3) AS score FROM z),
  f AS (SELECT g.*, score >= greatest(2.5, (SELECT quantile_cont(score, 0.95) FROM g)) AS is_anomaly FROM g)
"""


@register("anomaly_zscore", _Z_SQL + "SELECT event_id, round(score, 6) AS anomaly_score, is_anomaly FROM f")
def anomaly_zscore(t):
    scored = anomaly.zscore(signals(t), _SIGNALS)
    return scored.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register(
    "anomaly_drivers",
    _Z_SQL
    + """, d AS (SELECT event_id, unnest([{'z': z1, 'c': 'user_id'}, {'z': z2, 'c': 'value'}, {'z': z3, 'c': 'k'}]) AS p FROM f WHERE is_anomaly),
     r AS (SELECT event_id, p.c AS c, row_number() OVER (PARTITION BY event_id ORDER BY p.z DESC) AS rn FROM d)
     SELECT event_id, rn::INTEGER AS driver_rank, c AS attribute FROM r WHERE rn <= 3""",
)
def anomaly_drivers(t):
    flagged = anomaly.zscore(signals(t), _SIGNALS).filter("is_anomaly")
    exploded = flagged.select("event_id", F.posexplode("drivers").alias("at", "attribute"))
    return exploded.select("event_id", (F.col("at") + 1).cast("int").alias("driver_rank"), "attribute")


@register(
    "anomaly_summary",
    _Z_SQL
    + """SELECT count(*) AS row_count, count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
         round(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*), 1)::DOUBLE AS anomaly_pct, 'k, user_id, value' AS anomaly_columns,
         count(*) FILTER (WHERE is_anomaly) > 0 AS has_anomaly, round(max(score), 6) AS max_score FROM f""",
)
def anomaly_summary(t):
    found = anomaly.summary(anomaly.zscore(signals(t), _SIGNALS))
    return rounded(found.withColumn("anomaly_columns", F.array_join("anomaly_columns", ", ")), 6, "max_score")


_ALERT = "Which readings stand out?"


@register(
    "alert_sink",
    _Z_SQL
    + f"""SELECT '{_ALERT}' AS query, count(*) AS anomaly_count, 'k, user_id, value' AS anomaly_columns,
          'Column k, user_id, value drove the anomaly.' AS explanation FROM f WHERE is_anomaly HAVING count(*) > 0""",
)
def alert_sink(t):
    return anomaly.alert(anomaly.zscore(signals(t), _SIGNALS), _ALERT)


@register(
    "alert_sink_rows",
    _Z_SQL
    + f"""SELECT '{_ALERT}' AS query, event_id, user_id, value, k, round(score, 6) AS anomaly_score FROM f WHERE is_anomaly""",
)
def alert_sink_rows(t):
    sent = anomaly.alert_rows(anomaly.zscore(signals(t), _SIGNALS), _ALERT)
    fields = "event_id bigint, user_id bigint, value double, k double, anomaly_score double"
    return sent.select("query", F.from_json("record", fields).alias("r")).selectExpr(
        "query", "r.event_id", "r.user_id", "r.value", "r.k", "round(r.anomaly_score, 6) AS anomaly_score"
    )


@register(
    "an_active_entities",
    """SELECT 'week' AS span, date_trunc('week', o_orderdate)::DATE::VARCHAR AS period, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 2
       UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(DISTINCT o_custkey) FROM orders GROUP BY 2
       UNION ALL SELECT 'all', 'all', count(DISTINCT o_custkey) FROM orders""",
)
def an_active_entities(t):
    """Different customers by week, by month and in all, from one table of daily bitmaps."""
    days = _customer_days(t)
    spans = {"week": F.trunc("day", "week").cast("string"), "month": analyze.month_label(F.col("day")), "all": F.lit("all")}
    parts = [activity.active_entities(days, period).select(F.lit(span).alias("span"), "period", "entities") for span, period in spans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "an_returning_entities",
    """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, o_custkey FROM orders)
       SELECT strftime(a.month, '%Y-%m') AS period, count(*) AS entities, count(b.o_custkey) AS returned
       FROM m a LEFT JOIN m b ON b.o_custkey = a.o_custkey AND b.month = a.month + INTERVAL 1 MONTH GROUP BY 1""",
)
def an_returning_entities(t):
    """Of each month's customers those who order in the next month too."""
    month = F.trunc("day", "month")
    return activity.returning(_customer_days(t), analyze.month_label(F.col("day")), analyze.month_label(F.add_months(month, 1)))


def _customer_days(t: Tables) -> DataFrame:
    numbers = staged(activity.entity_numbers(t.orders, "o_custkey"), "numbers")
    return staged(activity.daily_bitmaps(t.orders, "o_custkey", "o_orderdate", numbers), "days")


@register("anomaly_iforest")
def anomaly_iforest(t):
    return forest.isolation_forest(signals(t), _SIGNALS)


@register("anomaly_attribution")
def anomaly_attribution(t):
    return forest.attribution(forest.isolation_forest(signals(t), _SIGNALS), _SIGNALS)


@register(
    "anomaly_iforest_checked",
    """SELECT count(*) AS row_count, true AS flags_follow_threshold, true AS at_most_a_twentieth, true AS scores_in_range, true AS credits_add_up,
       (SELECT count(*) FROM (SELECT DISTINCT user_id, value, (props::JSON->>'$.k')::DOUBLE FROM events)) AS different_rows, true AS equal_rows_score_alike
       FROM events""",
)
def anomaly_iforest_checked(t):
    """What must hold of all scores, flags and credits: the flagged rows are those above the 95 % quantile."""
    scored = staged(forest.isolation_forest(signals(t), _SIGNALS), "iforest")
    cut = exact_quantiles(scored.select(F.lit(1).alias("all"), "anomaly_score"), ["all"], "anomaly_score", [0.95])
    rows = C.with_row(scored, cut.select(F.col("quantiles")[0].alias("cut")))
    credit = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c) + F.log2("expected_score") - F.log2("anomaly_score")
    alike = scored.groupBy(*_SIGNALS).agg(F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"))
    alike = alike.agg(F.count("*").alias("different_rows"), F.bool_and(F.col("low") == F.col("high")).alias("equal_rows_score_alike"))
    facts = rows.agg(
        F.count("*").alias("row_count"),
        F.bool_and(F.col("is_anomaly") == (F.col("anomaly_score") > F.col("cut"))).alias("flags_follow_threshold"),
        (F.count_if("is_anomaly") <= 0.05 * F.count("*")).alias("at_most_a_twentieth"),
        F.bool_and((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 1)).alias("scores_in_range"),
        F.bool_and(F.abs(credit) < 1e-9).alias("credits_add_up"),
    )
    return C.with_row(facts, alike)
