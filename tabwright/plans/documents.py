"""Files, stored tables, metadata, classification and reports over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabwright.operators import classify, columns as C, flow, profile, report
from tabwright.operators.clean import clean_table
from tabwright.plans.analysis import ROLES_SQL, all_roles
from tabwright.plans.cleaning import CLEANED_NAMES, CLEANED_SQL, CLEAN_NAMES, RAW_NAMES, messy_orders
from tabwright.plans.registry import Tables, register
from tabwright.plans.values import EVERY_TABLE, LABELLED, SCHEMA, labelled_documents
from tabwright.session import scratch_path, ship_with_tasks
from tabwright.sources import readers, store as S
from tabwright.sources.workbook import read_workbooks

ship_with_tasks(__name__)

# --- files: written by Spark below the shared folder, then read back ---------------------------

_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register(
    "scan_csv",
    """SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def scan_csv(t):
    path = scratch_path(t.spark, "labelled") + ".csv"
    labelled_documents(t).write.csv(path, header=True, nullValue="NA")
    return readers.read_csv(t.spark, path)


@register("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(t):
    path = scratch_path(t.spark, "events") + ".json"
    t.events.select("event_id", "user_id", "event_type", "value", "props").write.json(path)
    return readers.read_json(t.spark, path)


def workbook_bytes(names: list[str], rows: list[list]) -> bytes:
    """A minimal workbook with one sheet of inline text and numbers."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [names, *rows])
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{lines}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _to_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        content = workbook_bytes(list(batch.columns), batch.astype(object).values.tolist())
        yield pd.DataFrame({"path": ["part.xlsx"], "content": [content]})


@register("scan_excel", f"SELECT {', '.join(_PART)} FROM part")
def scan_excel(t):
    books = t.part.select(*_PART).mapInPandas(_to_books, "path string, content binary")
    return readers.typed_from_text(read_workbooks(books))


@register(
    "read_any",
    """SELECT 'csv' AS kind, count(*) AS row_count, round(sum(c_acctbal), 2) AS total FROM customer
       UNION ALL SELECT 'json', count(*), round(sum(c_acctbal), 2) FROM customer
       UNION ALL SELECT 'parquet', count(*), round(sum(c_acctbal), 2) FROM customer""",
)
def read_any(t):
    result = None
    for kind in ("csv", "json", "parquet"):
        path = f"{scratch_path(t.spark, 'customer')}.{kind}"
        writer = t.customer.write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(path)
        counted = readers.read_any(t.spark, path).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("row_count"), F.round(F.sum("c_acctbal"), 2).alias("total")
        )
        result = counted if result is None else result.unionByName(counted)
    return result


# --- stored tables and metadata ------------------------------------------------------------------


def _store(t: Tables) -> S.Store:
    return S.Store(t.spark, scratch_path(t.spark, "store"))


_RAW_TYPES = ["bigint", *["string"] * 6, "double", "string", "string"]
_CLEAN_TYPES = {"order_id": "bigint", "order_date": "timestamp_ntz", "total_amount": "double", "rush": "boolean", "balance": "double"}


@register(
    "write_raw_clean",
    f"""{CLEANED_SQL.rstrip()}, columns(table_name, position, attribute, dtype) AS (VALUES """
    + ", ".join(f"('messy_orders__raw', {i}, '{c}', '{d}')" for i, (c, d) in enumerate(zip(RAW_NAMES, _RAW_TYPES)))
    + ", "
    + ", ".join(f"('user_data', {i}, '{c}', '{_CLEAN_TYPES.get(c, 'string')}')" for i, c in enumerate(CLEANED_NAMES))
    + """) SELECT *, CASE table_name WHEN 'user_data' THEN (SELECT count(*) FROM cleaned) ELSE (SELECT count(*) FROM raw) END AS row_count
    FROM columns""",
)
def write_raw_clean(t):
    store = _store(t)
    flow.clean_and_store(messy_orders(t), "messy_orders", store)
    kept = {"messy_orders__raw": store.read("messy_orders__raw"), "user_data": t.spark.table("user_data")}
    return S.catalog(kept)


_RENAMED = "|".join(f"{raw}>{clean}" for raw, clean in zip(RAW_NAMES, CLEAN_NAMES))


@register(
    "save_metadata",
    f"""{CLEANED_SQL.rstrip()} SELECT 'messy_orders' AS table_name, (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after,
        8 AS columns_after, '{_RENAMED}' AS mapping""",
)
def save_metadata(t):
    store, raw = _store(t), messy_orders(t)
    cleaned = clean_table(raw)
    store.save_metadata("messy_orders", cleaned.report("messy_orders"), cleaned.mapping)
    sizes = "rows_before bigint, rows_after bigint, columns_after int"
    reports = store.metadata("_cleaning_reports").select("table_name", F.from_json("report", sizes).alias("r"))
    pairs = F.transform(F.array(*[F.lit(c) for c in RAW_NAMES]), lambda c: F.concat(c, F.lit(">"), F.col("mapping")[c]))
    mappings = store.metadata("_column_mappings").select("table_name", F.array_join(pairs, "|").alias("mapping"))
    return reports.join(mappings, "table_name").select("table_name", "r.*", "mapping")


_REPORTS_SQL = """reports AS (SELECT 'customer_' || o_custkey AS table_name, (year(o_orderdate) - 1994)::INTEGER AS version, count(*) AS rows_clean,
    max(o_orderpriority) AS domain, count(DISTINCT o_orderstatus) AS clean_score FROM orders GROUP BY 1, 2)"""


def _reports(t: Tables) -> DataFrame:
    """A report per customer and year stands in for reports per table and version."""
    name = F.concat(F.lit("customer_"), F.col("o_custkey").cast("string"))
    return t.orders.groupBy(name.alias("table_name"), (F.year("o_orderdate") - 1994).alias("version")).agg(
        F.count("*").alias("rows_clean"),
        F.max("o_orderpriority").alias("domain"),
        F.count_distinct("o_orderstatus").alias("clean_score"),
    )


@register(
    "report_append_version",
    f"""WITH {_REPORTS_SQL} SELECT 'customer_' || c_custkey AS table_name, c_mktsegment AS report,
        coalesce((SELECT max(version) FROM reports r WHERE r.table_name = 'customer_' || c_custkey), 0)::INTEGER + 1 AS version FROM customer""",
)
def report_append_version(t):
    incoming = t.customer.select(
        F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("table_name"),
        F.col("c_mktsegment").alias("report"),
    )
    return S.append_versions(_reports(t), incoming)


@register(
    "report_get",
    f"WITH {_REPORTS_SQL} SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY version DESC) = 1",
)
def report_get(t):
    return S.report_get(_reports(t))


@register("report_get_version", f"WITH {_REPORTS_SQL} SELECT * FROM reports WHERE version = 4")
def report_get_version(t):
    return S.report_get(_reports(t), version=4)


_LOADED_SQL = """tables AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'customer_' || c_custkey || '__raw' WHEN 'MACHINERY' THEN '_customer_' || c_custkey
    ELSE 'customer_' || c_custkey END AS table_name, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS loaded_at FROM customer)"""


@register(
    "report_summaries",
    f"""WITH {_REPORTS_SQL}, {_LOADED_SQL},
    latest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY version DESC) = 1)
    SELECT t.table_name, coalesce(version, 1)::INTEGER AS version, coalesce(rows_clean, 0) AS rows_clean, coalesce(domain, 'Unknown') AS domain,
      coalesce(clean_score, 0) AS clean_score, loaded_at::VARCHAR AS loaded_at
    FROM tables t LEFT JOIN latest l ON t.table_name = l.table_name
    WHERE NOT starts_with(t.table_name, '_') AND NOT t.table_name LIKE '%\\_\\_raw' ESCAPE '\\'""",
)
def report_summaries(t):
    loads = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("loaded_at"))
    base = F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"))
    name = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(base, F.lit("__raw")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("_"), base))
        .otherwise(base)
    )
    tables = t.customer.join(loads, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        name.alias("table_name"), "loaded_at"
    )
    return S.report_summaries(tables, _reports(t)).withColumn("loaded_at", F.col("loaded_at").cast("string"))


def _overview_sql() -> str:
    parts = []
    for i, table in enumerate(EVERY_TABLE):
        flat = [c for c, kind in SCHEMA[table] if kind != "list"]
        counted = " + ".join(f"count(DISTINCT {c})" for c in flat)
        parts.append(f"SELECT {2 * i + 1} AS position, '{table} profile' AS section, {len(flat)}::BIGINT AS rows, ({counted})::BIGINT AS distinct_values FROM {table}")
        parts.append(f"SELECT {2 * i + 2}, '{table} sample', least(10, count(*)), NULL::BIGINT FROM {table}")
    return "\nUNION ALL ".join(parts)


def _section_rows(sections: DataFrame, *measures: str) -> DataFrame:
    """Rows per section, and the sums of some numbers of their records."""
    sums = [F.sum(F.get_json_object("record", f"$.{m}").cast("double")).cast("bigint").alias(m) for m in measures]
    return sections.groupBy("position", "section").agg(F.count("*").alias("rows"), *sums)


@register("dataset_overview", _overview_sql())
def dataset_overview(t):
    """Per table its column profiles and a ten-row sample: rows and distinct values of each section."""
    return _section_rows(dataset_overview_records(t), "distinct_count").withColumnRenamed("distinct_count", "distinct_values")


@register("dataset_overview_records")
def dataset_overview_records(t):
    """Column profiles and a ten-row sample per table, as records."""
    tables = {name: getattr(t, name) for name in EVERY_TABLE}
    parts = []
    for i, (name, df) in enumerate(tables.items()):
        sample = df.orderBy(df.columns[0]).limit(10)
        parts += [
            report.section(f"{name} profile", 2 * i + 1, profile.profile_table(df)),
            report.section(f"{name} sample", 2 * i + 2, sample),
        ]
    return report.build(parts)


_LOG_SQL = "log AS (SELECT 'Q' || conv_id AS question, role AS intent, text AS sql, turn AS logged_at FROM conversations)"


def _log(t: Tables) -> DataFrame:
    """Turns of a conversation stand in for repeated askings of one question."""
    return t.conversations.select(
        F.concat(F.lit("Q"), F.col("conv_id").cast("string")).alias("question"),
        F.col("role").alias("intent"),
        F.col("text").alias("sql"),
        F.col("turn").alias("logged_at"),
    )


@register(
    "query_log_upsert",
    f"WITH {_LOG_SQL} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY question ORDER BY logged_at DESC, intent DESC, sql DESC) = 1",
)
def query_log_upsert(t):
    return S.query_log_latest(_log(t))


_ENTITIES = ["that", "eaux", "ung"]


@register(
    "query_log_lookup",
    f"""SELECT text AS question, role AS intent FROM conversations WHERE {' OR '.join(f"contains(text, '{e}')" for e in _ENTITIES)}
        ORDER BY text LIMIT 5""",
)
def query_log_lookup(t):
    log = t.conversations.select(F.col("text").alias("question"), F.col("role").alias("intent"))
    return S.query_log_lookup(log, _ENTITIES)


@register(
    "export_json",
    """SELECT to_json({'doc_id': d.doc_id, 'lang': d.lang, 'source': d.source, 'quality': l.quality, 'toxic': l.toxic})::VARCHAR AS record
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def export_json(t):
    return S.export_json(labelled_documents(t))


# --- classification --------------------------------------------------------------------------------


def _catalog(t: Tables) -> DataFrame:
    return S.catalog({n: getattr(t, n) for n in EVERY_TABLE})


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


_CATALOG_SQL = (
    "names(table_name, position, attribute, is_number) AS (VALUES "
    + _values(
        [(tb, i, c, int(kind == "number")) for tb, cols in SCHEMA.items() for i, (c, kind) in enumerate(cols)]
    )
    + "), sizes AS ("
    + " UNION ALL ".join(f"SELECT '{tb}' AS table_name, count(*) AS row_count FROM {tb}" for tb in SCHEMA)
    + ")"
)


@register(
    "column_catalog",
    f"WITH {_CATALOG_SQL} SELECT n.table_name, position, attribute, is_number = 1 AS is_number, row_count FROM names n JOIN sizes s ON n.table_name = s.table_name",
)
def column_catalog(t):
    is_number = F.col("dtype").rlike("^(int|bigint|float|double|decimal)").alias("is_number")
    return _catalog(t).select("table_name", "position", "attribute", is_number, "row_count")


def _contains_any(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _domain_case(pick) -> str:
    branches = " ".join(f"WHEN {_contains_any('text', d[1])} THEN '{pick(d)}'" for d in classify.DOMAINS)
    return f"CASE {branches}"


@register(
    "classify_domain",
    f"""WITH {_CATALOG_SQL}, tables AS (
      SELECT table_name, lower(string_agg(attribute, ' ' ORDER BY position)) AS text,
        string_agg(attribute, '|' ORDER BY position) FILTER (WHERE position < 3) AS first_three,
        coalesce(min_by(attribute, position) FILTER (WHERE is_number = 1), 'metric') AS num,
        coalesce(min_by(attribute, position) FILTER (WHERE is_number = 0), 'category') AS cat FROM names GROUP BY table_name)
    SELECT t.table_name, row_count, {_domain_case(lambda d: d[0])} ELSE 'Other' END AS domain, 0.7::DOUBLE AS confidence,
      {_domain_case(lambda d: '|'.join(d[2]))} ELSE 'row_count|column_count' END AS likely_kpis,
      {_domain_case(lambda d: '|'.join(d[3]))} ELSE first_three END AS likely_dimensions,
      'What is the total distribution of ' || num || ' across the dataset?|Which ' || cat || ' accounts for the highest values?|'
        || 'How do key metrics break down by major dimensions?|Are there any notable anomalies or outliers in ' || num
        || '?|What are the top 5 records ranked by ' || num || '?' AS suggested_questions,
      'Inferred domain ''' || {_domain_case(lambda d: d[0])} ELSE 'Other' END || ''' via keyword match on schema columns.' AS reason
    FROM tables t JOIN sizes s ON t.table_name = s.table_name""",
)
def classify_domain(t):
    lists = ["likely_kpis", "likely_dimensions", "suggested_questions"]
    return classify.classify_domain(_catalog(t)).withColumns({c: F.array_join(c, "|") for c in lists})


_LISTED = ["date_columns", "value_columns", "group_columns"]
_DATASET_SQL = f"""roles AS ({ROLES_SQL}), datasets AS (
  SELECT table_name, lower(string_agg(attribute, ' ' ORDER BY position)) AS text,
    coalesce(min_by(attribute, position) FILTER (WHERE role = 'id'), min_by(attribute, position)) AS id_column,
    coalesce(string_agg(attribute, '|' ORDER BY position) FILTER (WHERE role = 'datetime'), '') AS date_columns,
    coalesce(string_agg(attribute, '|' ORDER BY position) FILTER (WHERE role = 'numeric' AND {_contains_any('lower(attribute)', classify.VALUE_PARTS)}), '') AS value_columns,
    min_by(attribute, position) FILTER (WHERE {_contains_any('lower(attribute)', classify.STATUS_PARTS)}) AS status_column,
    list(attribute ORDER BY position) FILTER (WHERE role = 'categorical') AS cats,
    list(attribute ORDER BY position) FILTER (WHERE role = 'numeric') AS nums,
    list(attribute ORDER BY position) FILTER (WHERE role = 'boolean') AS bools,
    list(attribute ORDER BY position) FILTER (WHERE role = 'datetime') AS dates
  FROM roles GROUP BY table_name),
typed AS (SELECT *, CASE {' '.join(f"WHEN {_contains_any('text', p)} THEN '{k}'" for k, _, _, p in classify.DATASET_TYPES)} ELSE 'generic' END AS dataset_type,
  coalesce(array_to_string(cats, '|'), '') AS group_columns FROM datasets)"""


@register(
    "classify_dataset",
    f"""WITH {_DATASET_SQL} SELECT table_name, dataset_type,
      CASE dataset_type {' '.join(f"WHEN '{k}' THEN '{e}'" for k, e, _, _ in classify.DATASET_TYPES)} ELSE 'record' END AS key_entity,
      CASE dataset_type {' '.join(f"WHEN '{k}' THEN {c}" for k, _, c, _ in classify.DATASET_TYPES)} ELSE 0.6 END::DOUBLE AS confidence,
      id_column, date_columns, value_columns, status_column, group_columns FROM typed""",
)
def classify_dataset(t):
    found = classify.classify_dataset(all_roles(t)).withColumns({c: F.array_join(c, "|") for c in _LISTED})
    return found.select(
        "table_name", "dataset_type", "key_entity", "confidence", "id_column", "date_columns", "value_columns",
        "status_column", "group_columns",
    )


_GROUP_SQL = "\nUNION ALL ".join(
    f"SELECT table_name, position, attribute, '{g}' AS column_group FROM names WHERE {_contains_any('attribute', p)}"
    for g, p in classify.COLUMN_GROUPS
)


@register(
    "column_groups",
    f"""WITH {_CATALOG_SQL}, hits AS ({_GROUP_SQL}) SELECT * FROM hits
        UNION ALL SELECT table_name, position, attribute, 'other' FROM names n
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.table_name = n.table_name AND h.position = n.position)""",
)
def column_groups(t):
    return classify.column_groups(_catalog(t))


_HAS_NUM, _HAS_CAT = "coalesce(len(nums), 0) > 0", "coalesce(len(cats), 0) > 0"
_TASKS = [
    ("descriptive_stats", _HAS_NUM, "nums"),
    ("distribution_analysis", _HAS_NUM, "nums"),
    ("correlation_analysis", "coalesce(len(nums), 0) >= 2", "nums"),
    ("outlier_detection", _HAS_NUM, "nums"),
    ("value_frequency", _HAS_CAT, "cats"),
    ("time_trend_analysis", "len(dates) > 0", "[dates[1]]"),
    ("status_breakdown", "coalesce(status_column, bools[1]) IS NOT NULL", "[coalesce(status_column, bools[1])]"),
    ("cohort_retention", "len(dates) > 0", "[id_column, dates[1]]"),
    ("entity_aggregation", _HAS_NUM, "list_concat([id_column], nums)"),
    ("group_comparison", f"{_HAS_CAT} AND {_HAS_NUM}", "[cats[1], nums[1]]"),
    ("cross_tabulation", "coalesce(len(cats), 0) >= 2", "cats[1:2]"),
    ("domain", "dataset_type <> 'generic'", "list_concat(coalesce(nums, []), coalesce(cats, []))"),
]


@register(
    "plan_tasks",
    f"WITH {_DATASET_SQL} "
    + "\nUNION ALL ".join(
        f"SELECT table_name, {i}::INTEGER AS position, "
        + ("'domain_' || replace(dataset_type, 'sensor_iot', 'sensor') || '_kpis'" if task == "domain" else f"'{task}'")
        + f" AS task, array_to_string({cols}, '|') AS columns FROM typed WHERE {when}"
        for i, (task, when, cols) in enumerate(_TASKS, start=1)
    ),
)
def plan_tasks(t):
    return classify.plan_tasks(all_roles(t)).withColumn("columns", F.array_join("columns", "|"))


# --- reports ----------------------------------------------------------------------------------------


@register(
    "report_key_metrics",
    """SELECT count(*) AS total_records, 6::BIGINT AS total_columns, 100.0::DOUBLE AS data_quality_score,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_row_count, format('{:,}', count(*)) AS records_text,
       '100.0/100' AS quality_text FROM orders""",
)
def report_key_metrics(t):
    return report.key_metrics(profile.profile_roles(t.orders), profile.quality_score_v1(t.orders))


@register(
    "report_limitations",
    """WITH d AS (SELECT d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT count(*) AS rows, round((count(*) - count(quality)) * 100.0 / count(*), 2)::DOUBLE AS q,
      round((count(*) - count(toxic)) * 100.0 / count(*), 2)::DOUBLE AS x,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS dup FROM d)
    SELECT 1 AS position, 'Columns with >5% missing values detected: quality (' || q || '%), toxic (' || x || '%).' AS limitation FROM m WHERE q > 5 AND x > 5
    UNION ALL SELECT 2, format('{:,}', dup) || ' duplicate rows detected prior to cleaning step.' FROM m WHERE dup > 0
    UNION ALL SELECT 4, 'No datetime columns detected; longitudinal and cohort retention analyses were skipped.' FROM m
    UNION ALL SELECT 6, 'Small dataset sample size (' || rows || ' rows); statistical findings should be interpreted with caution.' FROM m WHERE rows < 50""",
)
def report_limitations(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("text", "lang", "quality", "toxic")
    return report.limitations(profile.profile_roles(rows), C.duplicate_rows(rows))


@register(
    "report_build",
    """WITH m AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS dup FROM orders)
    SELECT 1 AS position, 'key_metrics' AS section, 1::BIGINT AS rows, n AS total_records, dup AS duplicate_row_count, NULL::BIGINT AS n FROM m
    UNION ALL SELECT 2, 'data_limitations', 2 + (dup > 0)::BIGINT + (n < 50)::BIGINT, NULL, NULL, NULL FROM m
    UNION ALL SELECT 3, 'describe_result', 3, NULL, NULL, 3 * n FROM m
    UNION ALL SELECT 4, 'domain_subscription_kpis', 1, NULL, NULL, NULL FROM m""",
)
def report_build(t):
    """The assembled report: rows of each section, with its sizes."""
    return _section_rows(report_build_records(t), "total_records", "duplicate_row_count", "n")


@register("report_build_records")
def report_build_records(t):
    roles = profile.profile_roles(t.orders)
    return report.build(
        [
            report.section("key_metrics", 1, report.key_metrics(roles, profile.quality_score_v1(t.orders))),
            report.section("data_limitations", 2, report.limitations(roles, C.duplicate_rows(t.orders))),
            report.section("describe_result", 3, report.describe_result(t.orders)),
            report.skipped_section(t.orders, "domain_subscription_kpis", 4, "No column fits the domain measures."),
        ]
    )


@register(
    "query_log_search",
    """WITH e AS (SELECT DISTINCT substr(text, 4, 14) AS entity FROM conversations WHERE conv_id % 5 = 0 AND length(text) > 3)
    SELECT DISTINCT text AS question FROM conversations WHERE EXISTS (SELECT 1 FROM e WHERE contains(text, entity))""",
)
def query_log_search(t):
    """All turns that mention any of the pieces of other turns."""
    entities = t.conversations.filter("conv_id % 5 = 0 AND length(text) > 3").select(F.substring("text", 4, 14).alias("entity"))
    return S.query_log_search(t.conversations.select(F.col("text").alias("question")), entities)


_ASKED = """SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id"""
_ANSWER_COLUMNS = ["user_id", "n", "total"]


@register(
    "question_result",
    f"""WITH a AS ({_ASKED}), m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _ANSWER_COLUMNS)} FROM a),
    z AS (SELECT greatest({', '.join(f'abs({c} - m_{c}) / s_{c}' for c in _ANSWER_COLUMNS)}) AS score FROM a, m),
    f AS (SELECT count(*) FILTER (WHERE score >= greatest(2.5, (SELECT quantile_cont(score, 0.95) FROM z))) AS flagged FROM z)
    """
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS attribute, count({c}) AS n, round(avg({c}), 4) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        (SELECT flagged FROM f) AS flagged, (SELECT flagged FROM f) > 0 AS alert_raised FROM a"""
        for c in _ANSWER_COLUMNS
    ),
)
def question_result(t):
    """A question's governed SQL, all its rows described, scored and, where rows stand out, alerted."""
    t.events.createOrReplaceTempView("events")
    answer = flow.question_result(t.spark, "Which users stand out?", _ASKED, default=None, cap=None)
    alerts = answer.alert.agg(F.count("*").alias("alerts"))
    sent = C.with_row(answer.alert_rows.agg(F.count("*").alias("flagged")), alerts)
    described = answer.description.select("attribute", "n", F.round("mean", 4).alias("mean"), "min", "max")
    return C.with_row(described, sent.select("flagged", (F.col("alerts") > 0).alias("alert_raised")))


@register(
    "dataset_report",
    """SELECT 'customer' AS table_name, count(*) AS rows_raw, (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS rows_clean,
       5 AS columns_count, (count(DISTINCT c_custkey) + count(DISTINCT c_name) + count(DISTINCT c_nationkey) + count(DISTINCT c_acctbal)
       + count(DISTINCT c_mktsegment))::BIGINT AS distinct_values, round(avg(c_acctbal), 4) AS mean_balance FROM customer""",
)
def dataset_report(t):
    """The report row of a cleaned table: its sizes and what its profile adds up to."""
    found = _customer_report(t)
    total = F.aggregate("profile", F.lit(0).cast("bigint"), lambda a, c: a + c["distinct_count"])
    balance = F.filter("profile", lambda c: c["attribute"] == "c_acctbal")[0]["mean"]
    return found.select("table_name", "rows_raw", "rows_clean", "columns_count", total.alias("distinct_values"), balance.alias("mean_balance"))


def _customer_report(t) -> DataFrame:
    cleaned = clean_table(t.customer)
    return flow.dataset_report("customer", cleaned, cleaned.report("customer"))


@register("dataset_report_record")
def dataset_report_record(t):
    return _customer_report(t).select("table_name", "rows_raw", "rows_clean", "columns_count", F.to_json(F.struct("*")).alias("report"))


def _sections_sql() -> str:
    """Rows of the sections of the messy orders' analysis; charts of scores have no count in SQL."""
    month = "strftime(order_date, '%Y-%m')"
    values = " + ".join(f"least(10, count(DISTINCT {c}))" for c in ("customer_name", "discount_code", "channel"))
    rows = [
        ("key_metrics", "1"), ("data_limitations", "3"), ("descriptive_stats", "2"), ("chart_box", "2"), ("distribution_analysis", "2"),
        ("chart_histogram", "40"), ("correlation_analysis", "1"), ("correlation_leaders", "1"), ("outlier_detection", "1"),
        ("flagged_rows", "10"), ("chart_scatter", "NULL"), ("value_frequency", "3"), ("chart_bar", values),
        ("time_trend_analysis", f"least(12, count(DISTINCT {month}))"), ("trend_extremes", "1"), ("status_breakdown", "count(DISTINCT rush)"),
        ("cohort_retention", f"least(12, count(DISTINCT {month}))"), ("largest_cohort", "1"), ("retention", f"count(DISTINCT {month})"),
        ("entity_aggregation", "1"), ("top_entities", "least(10, count(DISTINCT order_id))"),
        ("group_comparison", "least(10, count(DISTINCT customer_name))"), ("group_extremes", "1"),
        ("group_comparison", "count(DISTINCT discount_code)"), ("group_extremes", "1"),
        ("group_comparison", "count(DISTINCT channel)"), ("group_extremes", "1"),
        ("cross_tabulation", "count(DISTINCT (customer_name, discount_code)) FILTER (WHERE customer_name IS NOT NULL AND discount_code IS NOT NULL)"),
        ("domain_sales_kpis", "8"),
    ]
    one = lambda n: n if "(" in n else f"max({n})"
    parts = [f"SELECT {i} AS position, '{name}' AS section, ({one(n)})::BIGINT AS rows FROM cleaned" for i, (name, n) in enumerate(rows, 1)]
    return CLEANED_SQL + "\nUNION ALL ".join(parts)


@register("auto_analysis", _sections_sql())
def auto_analysis(t):
    """The whole analysis of the messy orders: its sections in order, and their rows."""
    sections = flow.auto_analysis(messy_orders(t), "messy_orders", _store(t)).sections
    counted = _section_rows(sections.filter("record IS NOT NULL"))
    return counted.withColumn("rows", F.when(F.col("section") != "chart_scatter", F.col("rows")))


@register("auto_analysis_records")
def auto_analysis_records(t):
    return flow.auto_analysis(messy_orders(t), "messy_orders", _store(t)).sections
