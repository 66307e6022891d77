"""From a raw table to a stored clean table, its versioned profile and its analysis report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tabwright.operators import analyze, anomaly, charts, classify, forest, kpis, quality, report
from tabwright.operators import columns as C
from tabwright.operators.clean import Cleaned, clean_table
from tabwright.operators.profile import profile_roles, profile_table, quality_score_v1
from tabwright.operators.sqlgate import DEFAULT_ROWS, MAX_ROWS, safe_rows
from tabwright.session import staged
from tabwright.sources.readers import missing_to_null, read_any
from tabwright.sources.store import Store, catalog


@dataclass
class Analysis:
    """Where an analysis ended up: the title, the stored clean table and the report rows."""

    title: str
    clean: DataFrame
    roles: DataFrame
    classification: Row
    sections: DataFrame


def clean_and_store(raw: DataFrame, name: str, store: Store) -> tuple[DataFrame, Cleaned, DataFrame]:
    """Stored raw twin, cleaning result and stored clean table."""
    kept = store.write_raw(name, missing_to_null(raw))
    cleaned = clean_table(kept, stage=lambda df: staged(df, "clean"))
    clean = store.write_clean(name, cleaned.df)
    cleaned.df = clean
    return kept, cleaned, clean


def with_table_name(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "*")


def domain_section(kind: str, df: DataFrame, c: Row) -> DataFrame | None:
    """The measure each dataset type adds."""
    numbers, categories = c["numeric_columns"], c["categorical_columns"]
    first = numbers[0] if numbers else None
    counted = {
        "hr": kpis.DEPARTMENT_PARTS, "healthcare": kpis.DIAGNOSIS_PARTS, "marketing": kpis.CHANNEL_PARTS,
    }
    if kind in counted and categories:
        return kpis.class_counts(df, kpis.pick_column(categories, counted[kind]))
    if kind == "sales" and c["id_column"] and first:
        amounts = c["value_columns"] or numbers
        product = kpis.pick_column(categories or [c["id_column"]], ["product", "sku", "item"])
        customer = kpis.pick_column(df.columns, ["customer", "client", "user"])
        return kpis.sales(df, c["id_column"], customer, product, kpis.pick_column(amounts, ["total", "amount", "revenue"]))
    if kind == "subscription" and c["date_columns"] and first:
        dates = c["date_columns"]
        ended = next((d for d in dates if "cancel" in d or "churn" in d or "end" in d), dates[-1])
        as_of = df.agg(F.max(F.greatest(*[F.coalesce(C.col(d), C.col(dates[0])) for d in dates]) if len(dates) > 1 else C.col(dates[0]))).first()[0]
        fee = (c["value_columns"] or numbers)[0]
        return kpis.subscription(df, dates[0], ended, fee, str(as_of)[:10])
    if first and kind == "education":
        return kpis.mean_score(df, first)
    if first and kind == "sports":
        return kpis.peak_score(df, first)
    if first and kind == "sensor_iot":
        return kpis.signal_stability(df, first)
    return None


def outlier_summary(scored: DataFrame, numbers: list[str], k: int = 2) -> DataFrame:
    """The summary of the scores with the k columns that contribute most over all rows."""
    leading = forest.attribution(scored, numbers).limit(k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("mean_contribution")).alias("c"), "attribute")))
    return C.with_row(anomaly.summary(scored), leading.agg(order["attribute"].alias("primary_drivers")))


def top_flagged(scored: DataFrame, numbers: list[str], k: int = 10) -> DataFrame:
    """The k flagged rows of the highest scores; ties go to the smaller values."""
    shown = scored.filter("is_anomaly").select(*[C.col(c) for c in numbers], "anomaly_score")
    return shown.orderBy(F.desc("anomaly_score"), *[C.col(c) for c in numbers]).limit(k)


def of_columns(table: DataFrame, *columns: str) -> DataFrame:
    """A section that covers some of the columns says which."""
    return table.withColumn("of_columns", F.array(*[F.lit(c) for c in columns]))


def task_tables(task: str, df: DataFrame, c: Row) -> list[tuple[str, DataFrame]]:
    """(section, table) pairs one planned task yields."""
    numbers, categories = c["numeric_columns"], c["categorical_columns"]
    values, dates = c["value_columns"] or numbers, c["date_columns"]
    status = c["status_column"] or next(iter(c["boolean_columns"]), None)
    if task == "descriptive_stats":
        return [(task, analyze.descriptive(df, numbers)), ("chart_box", charts.box(df, numbers))]
    if task == "distribution_analysis":
        return [(task, analyze.distribution(df, numbers)), ("chart_histogram", charts.histogram(df, numbers))]
    if task == "correlation_analysis":
        return [(task, analyze.correlation(df, numbers)), ("correlation_leaders", analyze.correlation_leaders(df, numbers))]
    if task == "outlier_detection":
        scored = forest.isolation_forest(df, numbers, min_rows=6)
        grid = charts.density(scored, numbers[0], "anomaly_score", "is_anomaly")
        return [
            (task, outlier_summary(scored, numbers)),
            ("flagged_rows", top_flagged(scored, numbers)),
            ("chart_scatter", grid),
        ]
    if task == "value_frequency":
        return [(task, analyze.value_frequency(df, categories)), ("chart_bar", analyze.top_categories(df, categories))]
    if task == "time_trend_analysis":
        found = []
        for date in dates:
            trend = analyze.time_trend(df, date, values[0] if values else None)
            found += [(task, analyze.last_periods(trend)), ("trend_extremes", analyze.peak_and_low(trend))]
            found[-2:] = [(s, of_columns(part, date, *values[:1])) for s, part in found[-2:]]
        return found
    if task == "status_breakdown":
        return [(task, analyze.status_breakdown(df, status))]
    if task == "cohort_retention":
        sizes = analyze.cohort_sizes(df, c["id_column"], dates[0])
        return [
            (task, analyze.last_periods(sizes, period="cohort")),
            ("largest_cohort", analyze.largest_cohort(sizes)),
            ("retention", analyze.cohort_retention(df, c["id_column"], dates[0])),
        ]
    if task == "entity_aggregation":
        return [(task, analyze.entity_summary(df, c["id_column"])), ("top_entities", analyze.top_entities(df, c["id_column"]))]
    if task == "group_comparison":
        found = []
        for group in categories:
            compared = analyze.group_comparison(df, group, values[0])
            pair = [(task, compared), ("group_extremes", analyze.group_extremes(compared))]
            found += [(s, of_columns(part, group, values[0])) for s, part in pair]
        return found
    if task == "cross_tabulation":
        table = analyze.crosstab(df, categories[0], categories[1])
        return [(task, of_columns(table, categories[0], categories[1]))]
    domain = domain_section(c["dataset_type"], df, c)
    if domain is None:
        raise ValueError("No column fits the domain measures.")
    return [(task, domain)]


def auto_analysis(raw: DataFrame, name: str, store: Store) -> Analysis:
    """Clean, profile, classify, plan, run and store. A section that fails is kept with its reason."""
    raw, cleaned, clean = clean_and_store(raw, name, store)
    # Both are read by several sections, and cost a shuffle of the whole table each.
    copies, left = staged(C.duplicate_rows(raw), "raw-copies"), staged(C.duplicate_rows(clean), "clean-copies")
    store.save_metadata(name, cleaned.report(name, (copies, left)), cleaned.mapping)
    roles = staged(with_table_name(profile_roles(clean), name), "roles")
    c = classify.classify_dataset(roles).first()
    tasks = classify.plan_tasks(roles).orderBy("position").collect()

    log = f"{name}__report"
    first = [
        ("key_metrics", report.key_metrics(roles, quality_score_v1(clean, left))),
        ("data_limitations", report.limitations(roles, copies, c["id_column"])),
    ]
    position = 0

    def keep(section: str, build) -> None:
        nonlocal position
        position += 1
        mode = "overwrite" if position == 1 else "append"
        try:
            report.section(section, position, build()).write.mode(mode).parquet(store._path(log))
        except (PySparkException, ValueError) as error:
            reason = str(error).splitlines()[0]
            report.skipped_section(clean, section, position, reason).write.mode(mode).parquet(store._path(log))

    for section, table in first:
        keep(section, lambda table=table: table)
    for task in tasks:
        try:
            tables = task_tables(task["task"], clean, c)
        except (PySparkException, ValueError) as error:
            message = str(error)
            keep(task["task"], lambda: (_ for _ in ()).throw(ValueError(message)))
            continue
        for section, table in tables:
            keep(section, lambda table=table: table)
    return Analysis(report.title(c["dataset_type"], c["key_entity"]), clean, roles, c, store.read(log))


def dataset_report(name: str, cleaned: Cleaned, summary: DataFrame) -> DataFrame:
    """One row: sizes, quality, domain, column profile and cleaning summary, ready to be versioned."""
    profiled = profile_table(cleaned.df)
    columns = profiled.agg(
        # As many entries as the table has columns.
        F.array_sort(F.collect_list(F.struct("position", *[c for c in profiled.columns if c != "position"]))).alias(
            "profile"
        ),
        F.max("row_count").alias("rows_clean"),
        F.count("*").cast("int").alias("columns_count"),
    )
    domain = classify.classify_domain(catalog({name: cleaned.df}))
    cleaning = summary.select(F.struct(*summary.columns).alias("cleaning"))
    parts = C.with_row(C.with_row(domain, columns), cleaning)
    facts = ["domain", "confidence", "reason", "likely_kpis", "likely_dimensions", "suggested_questions"]
    return parts.select(
        "table_name",
        F.col("cleaning.rows_before").alias("rows_raw"),
        "rows_clean",
        "columns_count",
        F.struct("cleaning.raw_score", "cleaning.clean_score", "cleaning.issues").alias("quality"),
        F.struct(*facts).alias("domain"),
        "profile",
        "cleaning",
    )


@dataclass
class Answer:
    """What a question gave: rows, whether more exist, their description, scores and the alert."""

    rows: DataFrame
    cut: bool
    description: DataFrame
    scored: DataFrame
    alert: DataFrame
    alert_rows: DataFrame


def question_result(
    spark: SparkSession, question: str, sql: str, default: int | None = DEFAULT_ROWS, cap: int | None = MAX_ROWS
) -> Answer:
    """Run governed SQL, write its rows once, describe them, score them and raise the alert.

    The gate bounds the rows unless ``default`` and ``cap`` lift its limits; ``cut`` says whether it left
    any out. An empty result has an empty description of numbers, no scores and no alert.
    """
    rows, cut = safe_rows(spark, sql, default, cap)
    scored = anomaly.zscore(rows)
    return Answer(
        rows, cut, report.describe_result(rows), scored, anomaly.alert(scored, question), anomaly.alert_rows(scored, question)
    )


def load_file(store: Store, path: str, name: str) -> DataFrame:
    """Read a file, store raw and clean tables, and append the next report version."""
    _, cleaned, clean = clean_and_store(read_any(store.spark, path), name, store)
    summary = staged(cleaned.report(name), "summary")
    store.save_metadata(name, summary, cleaned.mapping)
    store.append_report(dataset_report(name, cleaned, summary))
    return clean
