"""Domain, dataset type and planned analyses for many tables at once, from their catalog.

``catalog``: (table_name, position, attribute, dtype); ``roles`` adds a role per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Domain, name parts that reveal it, its measures and its dimensions.
DOMAINS = [
    (
        "Sales",
        ["sale", "order", "product", "customer", "revenue", "profit", "store", "unit_price"],
        ["total_revenue", "order_count", "average_order_value"],
        ["product_category", "customer_segment", "store_region"],
    ),
    (
        "HR",
        ["employee", "salary", "department", "hire", "hr", "payroll", "job", "worker"],
        ["headcount", "average_salary", "tenure_years"],
        ["department", "job_role", "office_location"],
    ),
    (
        "Healthcare",
        ["patient", "hospital", "clinical", "diagnosis", "disease", "treatment", "doctor", "comorbidity", "pneumonia"],
        ["patient_count", "readmission_rate", "average_stay_days"],
        ["diagnosis_category", "patient_type", "treatment_group"],
    ),
    (
        "Finance",
        ["transaction", "account", "balance", "bank", "credit", "loan", "debit", "interest"],
        ["total_balance", "transaction_volume", "default_rate"],
        ["account_type", "credit_tier", "transaction_channel"],
    ),
    (
        "Marketing",
        ["campaign", "click", "impression", "lead", "conversion", "ad", "channel"],
        ["conversion_rate", "cost_per_acquisition", "total_clicks"],
        ["campaign_name", "traffic_source", "ad_group"],
    ),
    (
        "Inventory",
        ["stock", "warehouse", "sku", "supplier", "inventory", "reorder", "quantity"],
        ["total_stock_value", "turnover_rate", "out_of_stock_count"],
        ["warehouse_location", "supplier_name", "item_category"],
    ),
    (
        "Education",
        ["student", "course", "grade", "gpa", "exam", "school", "teacher", "enrollment"],
        ["average_gpa", "pass_rate", "student_count"],
        ["course_name", "department", "academic_year"],
    ),
]

# Dataset type, key entity, confidence and the name parts that reveal it.
DATASET_TYPES = [
    ("subscription", "customer", 0.85, ["subscription", "sub_id", "signup", "cancel", "churn", "mrr", "plan", "recurring"]),
    ("sales", "order", 0.85, ["order", "revenue", "sales", "price", "product", "sku", "item", "discount"]),
    ("healthcare", "patient", 0.80, ["patient", "diagnosis", "hospital", "doctor", "admission", "treatment", "medical"]),
    ("hr", "employee", 0.80, ["employee", "department", "salary", "hire_date", "tenure", "hr", "payroll"]),
    ("education", "student", 0.80, ["student", "grade", "score", "subject", "exam", "course", "gpa", "school"]),
    ("sports", "match", 0.80, ["player", "match", "team", "score", "wickets", "runs", "goals", "league"]),
    ("sensor_iot", "sensor_reading", 0.80, ["sensor", "temperature", "voltage", "reading", "device", "iot", "humidity"]),
]

# Name parts of value and status columns.
VALUE_PARTS = ["amount", "price", "revenue", "mrr", "total", "score", "qty", "val", "fee", "cost", "salary"]
STATUS_PARTS = ["status", "state", "churn", "flag", "active", "pass", "outcome"]

# Column groups shown in an overview, by name parts.
COLUMN_GROUPS = [
    ("demographics", ["age", "sex", "gender", "unit", "location", "country", "region", "state", "city"]),
    ("metrics", ["price", "amount", "cost", "revenue", "salary", "total", "score", "count", "value", "quantity"]),
    ("dates", ["date", "time", "year", "month", "created", "updated", "joined"]),
]

_NUMERIC_DTYPE = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def _mentions(text: Column, parts: list[str], whole_words: bool) -> Column:
    if whole_words:
        return text.rlike(r"(^|[^a-z0-9])(" + "|".join(parts) + r")s?([^a-z0-9]|$)")
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _first(value: str, keep: Column) -> Column:
    """Leftmost column of a table that meets a condition."""
    return F.min_by(F.when(keep, F.col(value)), F.when(keep, F.col("position")))


def _names(keep: Column) -> Column:
    """Names in column order; a table has as many as its schema."""
    kept = F.collect_list(F.when(keep, F.struct("position", "attribute")))
    return F.transform(F.array_sort(kept), lambda s: s["attribute"])


def classify_domain(catalog: DataFrame, whole_words: bool = False) -> DataFrame:
    """Business domain per table with its likely measures, dimensions and five questions.

    By default a part may occur anywhere in a name; ``whole_words`` asks for a word of
    its own (so 'ad' no longer matches 'load').
    """
    numeric = F.lower("dtype").rlike(_NUMERIC_DTYPE)
    tables = catalog.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        _names(F.lit(True)).alias("names"),
        _first("attribute", numeric).alias("first_number"),
        _first("attribute", ~numeric).alias("first_other"),
    )
    text = F.lower(F.array_join("names", " "))
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    domain, kpis, dims = F, F, F
    for name, parts, measures, dimensions in DOMAINS:
        hit = _mentions(text, parts, whole_words)
        domain, kpis, dims = (
            domain.when(hit, name), kpis.when(hit, words(measures)), dims.when(hit, words(dimensions)),
        )
    number = F.coalesce("first_number", F.lit("metric"))
    category = F.coalesce("first_other", F.lit("category"))
    # The five questions.
    questions = F.array(
        F.format_string("What is the total distribution of %s across the dataset?", number),
        F.format_string("Which %s accounts for the highest values?", category),
        F.lit("How do key metrics break down by major dimensions?"),
        F.format_string("Are there any notable anomalies or outliers in %s?", number),
        F.format_string("What are the top 5 records ranked by %s?", number),
    )
    named = tables.select(
        "table_name",
        "row_count",
        domain.otherwise("Other").alias("domain"),
        F.lit(0.70).alias("confidence"),
        kpis.otherwise(words(["row_count", "column_count"])).alias("likely_kpis"),
        dims.otherwise(F.slice("names", 1, 3)).alias("likely_dimensions"),
        questions.alias("suggested_questions"),
    )
    reason = F.format_string("Inferred domain '%s' via keyword match on schema columns.", "domain")
    return named.withColumn("reason", reason)


def classify_dataset(roles: DataFrame, whole_words: bool = False, most_groups: int | None = None) -> DataFrame:
    """Dataset type, key entity and the columns that play a part, per table.

    ``group_columns`` are all categorical columns, or the first ``most_groups``.
    """
    groups = _names(F.col("role") == "categorical")
    name, role = F.lower("attribute"), F.col("role")
    tables = roles.groupBy("table_name").agg(
        _names(F.lit(True)).alias("names"),
        F.coalesce(_first("attribute", role == "id"), _first("attribute", F.lit(True))).alias("id_column"),
        _names(role == "datetime").alias("date_columns"),
        _names((role == "numeric") & _mentions(name, VALUE_PARTS, whole_words)).alias("value_columns"),
        _first("attribute", _mentions(name, STATUS_PARTS, whole_words)).alias("status_column"),
        (F.slice(groups, 1, most_groups) if most_groups else groups).alias("group_columns"),
        _names(role == "numeric").alias("numeric_columns"),
        _names(role == "categorical").alias("categorical_columns"),
        _names(role == "boolean").alias("boolean_columns"),
        _names(role == "id").alias("id_columns"),
    )
    text = F.lower(F.array_join("names", " "))
    kind, entity, confidence = F, F, F
    for dataset_type, key_entity, sure, parts in DATASET_TYPES:
        hit = _mentions(text, parts, whole_words)
        kind, entity, confidence = (
            kind.when(hit, dataset_type), entity.when(hit, key_entity), confidence.when(hit, sure),
        )
    return tables.select(
        "table_name",
        kind.otherwise("generic").alias("dataset_type"),
        entity.otherwise("record").alias("key_entity"),
        confidence.otherwise(0.60).alias("confidence"),
        *[c for c in tables.columns if c not in ("table_name", "names")],
    )


def column_groups(catalog: DataFrame) -> DataFrame:
    """Overview group per column; a column may belong to several."""
    name = F.lower("attribute")
    hits = [F.when(_mentions(name, parts, False), group) for group, parts in COLUMN_GROUPS]
    found = F.array_compact(F.array(*hits))
    groups = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))
    return catalog.select("table_name", "position", "attribute", F.explode(groups).alias("column_group"))


def plan_tasks(roles: DataFrame) -> DataFrame:
    """(table_name, position, task, columns): the analyses each table's roles allow."""
    t = classify_dataset(roles)
    numeric, categories = F.col("numeric_columns"), F.col("categorical_columns")
    date = F.get("date_columns", F.lit(0))
    status = F.coalesce("status_column", F.get("boolean_columns", F.lit(0)))
    has_number, has_category = F.size(numeric) > 0, F.size(categories) > 0
    domain = F.col("dataset_type")
    tasks = [
        ("descriptive_stats", has_number, numeric),
        ("distribution_analysis", has_number, numeric),
        ("correlation_analysis", F.size(numeric) >= 2, numeric),
        ("outlier_detection", has_number, numeric),
        ("value_frequency", has_category, categories),
        ("time_trend_analysis", date.isNotNull(), F.array(date)),
        ("status_breakdown", status.isNotNull(), F.array(status)),
        ("cohort_retention", F.col("id_column").isNotNull() & date.isNotNull(), F.array("id_column", date)),
        ("entity_aggregation", F.col("id_column").isNotNull() & has_number,
         F.concat(F.array("id_column"), numeric)),
        ("group_comparison", has_category & has_number, F.array(F.get(categories, F.lit(0)), F.get(numeric, F.lit(0)))),
        ("cross_tabulation", F.size(categories) >= 2, F.slice(categories, 1, 2)),
        ("domain_kpis", domain != "generic", F.concat(numeric, categories)),
    ]
    planned = F.array_compact(
        F.array(
            *[
                F.when(
                    when,
                    F.struct(
                        F.lit(i).alias("position"),
                        (F.format_string("domain_%s_kpis", F.replace(domain, F.lit("sensor_iot"), F.lit("sensor")))
                         if task == "domain_kpis" else F.lit(task)).alias("task"),
                        columns.alias("columns"),
                    ),
                )
                for i, (task, when, columns) in enumerate(tasks, start=1)
            ]
        )
    )
    return t.select("table_name", F.inline(planned))
