"""Analyses that apply to any table once its column roles are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions import stats
from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators import columns as C
from tabwright.operators.pairs import correlations
from tabwright.operators.profile import numeric_summary
from tabwright.session import staged

SKEWED_BEYOND = 1.0
WEEKLY_BELOW_DAYS = 90


# --- numeric columns -----------------------------------------------------------


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: n, variance, adjusted skewness and adjusted excess kurtosis."""
    moments = {
        "variance": "coalesce(var_samp(value), 0D)",
        "skewness": stats.adjusted_skew("value"),
        "kurtosis": stats.adjusted_kurtosis("value"),
    }
    return C.per_number(df, columns, moments)


def descriptive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Summary per numeric column, with the widest and the most skewed column named."""
    shapes = shape(df, columns)
    leaders = shapes.agg(
        F.max_by("attribute", F.struct("variance", (-F.col("position")).alias("p"))).alias("highest_variance"),
        F.max_by("attribute", F.struct(F.abs("skewness").alias("s"), (-F.col("position")).alias("p"))).alias(
            "most_skewed"
        ),
    )
    summary = numeric_summary(df, columns).filter("n > 0")
    shown = {"mean": "mean", "median": "median", "std": "std", "min": "min", "max": "max", "p25": "q1", "p75": "q3"}
    table = summary.selectExpr("attribute", *[f"round({c}, 4) AS {to}" for c, to in shown.items()])
    return C.with_row(table, leaders)


def distribution(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Skewness, kurtosis and distribution class of the numeric columns, or of the first ``most``."""
    kind = (
        F.when(F.col("skewness") > SKEWED_BEYOND, "Strongly Right-Skewed")
        .when(F.col("skewness") < -SKEWED_BEYOND, "Strongly Left-Skewed")
        .otherwise("Approximately Normal")
    )
    return (
        shape(df, columns[:most])
        .filter("n >= 3")
        .select("attribute", F.round("skewness", 2).alias("skewness"), F.round("kurtosis", 2).alias("kurtosis"),
                kind.alias("distribution_class"))
    )


def correlation_pairs(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """(col1, col2, correlation) for every column pair, nulls ignored pair by pair. One scan for any number of columns."""
    names = F.array(*[F.lit(c) for c in columns])
    found = correlations(df, columns)
    return found.select(F.get(names, F.col("i")).alias("col1"), F.get(names, F.col("j")).alias("col2"), F.round("r", digits).alias("correlation"))


def strongest_pairs(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    pairs = correlation_pairs(df, columns).filter("correlation is not null")
    return pairs.orderBy(F.desc(F.abs("correlation")), "col1", "col2").limit(k)


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r (3 dp) per pair over rows where every column is present."""
    complete = df.select(*[C.col(c) for c in columns]).na.drop()
    return correlation_pairs(complete, columns, digits=3)


def correlation_leaders(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """The k strongest positive and the k strongest negative pairs."""
    pairs = correlation(df, columns)
    # format_number rounds the exact binary value, as printf does; format_string does not.
    label = F.expr("concat(col1, ' & ', col2, ' (', if(correlation < 0, '', '+'), format_number(correlation, 2), ')')")
    strength = F.abs("correlation")

    def side(direction: str, keep: Column) -> DataFrame:
        best = pairs.filter(keep).orderBy(F.desc(strength), "col1", "col2").limit(k)
        return best.select(F.lit(direction).alias("direction"), "col1", "col2", "correlation", label.alias("label"))

    return side("positive", F.col("correlation") > 0).unionByName(side("negative", F.col("correlation") < 0))


# --- categories ------------------------------------------------------------------


def value_frequency(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Classes, dominant class and its share of all rows, for all columns or the first ``most``."""
    counts = C.value_counts(df, columns[:most])
    leading = counts.groupBy("attribute").agg(
        F.count("*").alias("unique_classes"),
        F.min_by("value", F.struct((-F.col("n")).alias("c"), "value")).alias("dominant_class"),
        F.max("n").alias("dominant_count"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("row_count"))
    share = F.round(F.col("dominant_count") / F.col("row_count") * 100.0, 1)
    return C.with_row(leading, rows).select(
        "attribute", "unique_classes", "dominant_class", "dominant_count", share.alias("dominant_share_pct")
    )


def top_categories(df: DataFrame, columns: list[str], k: int = 10, most: int | None = None) -> DataFrame:
    top = C.top_values(C.value_counts(df, columns[:most]), k)
    return top.select("attribute", "rank", "value", "n")


def shares(df: DataFrame, key: Column, label: str, total: Column | None = None) -> DataFrame:
    """Group sizes (or sums) and their percentage of the whole, without a single-task window."""
    measure = F.count("*") if total is None else F.sum(total)
    groups = df.groupBy(key.alias(label)).agg(measure.alias("amount"))
    whole = groups.agg(F.sum("amount").alias("whole"))
    pct = F.round(F.lit(100.0) * F.col("amount") / F.col("whole"), 1)
    return C.with_row(groups, whole).select(label, "amount", pct.alias("pct"))


def status_breakdown(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per state; a missing state is a state of its own."""
    state = F.coalesce(C.col(column).cast("string"), F.lit("nan"))
    return shares(df, state, "status_state").withColumnRenamed("amount", "n")


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """(row_value, col_value, n, pct): counts with row-normalised percentages, long form."""
    a, b = C.col(rows).cast("string"), C.col(cols).cast("string")
    cells = (
        df.select(a.alias("row_value"), b.alias("col_value"))
        .na.drop()
        .groupBy("row_value", "col_value")
        .agg(F.count("*").alias("n"))
    )
    totals = cells.groupBy("row_value").agg(F.sum("n").alias("total"))
    pct = F.round(F.col("n") / F.col("total"), 3) * 100.0
    return cells.join(totals, "row_value").select("row_value", "col_value", "n", pct.alias("pct"))


# --- time --------------------------------------------------------------------------


def month_label(date: Column) -> Column:
    return F.substring(date.cast("date").cast("string"), 1, 7)


def week_label(date: Column) -> Column:
    monday = F.trunc(date.cast("date"), "week")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def time_trend(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Totals per period: weeks when the data spans under 90 days, else months."""
    dated = df.filter(C.col(date).isNotNull())
    span = dated.agg(
        F.timestamp_diff("DAY", F.min(C.col(date)).cast("timestamp"), F.max(C.col(date)).cast("timestamp")).alias(
            "span_days"
        )
    )
    number = F.coalesce(C.col(value).cast("double"), F.lit(0.0)).alias("v") if value else F.lit(1.0).alias("v")
    rows = C.with_row(dated.select(C.col(date).alias("d"), number), span)
    weekly = F.col("span_days") < WEEKLY_BELOW_DAYS
    period = F.when(weekly, week_label(F.col("d"))).otherwise(month_label(F.col("d")))
    measures = [F.count("*").alias("record_count")]
    if value:
        measures = [F.sum("v").alias("total_value"), F.avg("v").alias("average_value"), *measures]
    return rows.groupBy(period.alias("period")).agg(*measures)


def last_periods(trend: DataFrame, k: int = 12, period: str = "period") -> DataFrame:
    return trend.orderBy(F.desc(period)).limit(k).orderBy(period)


def peak_and_low(trend: DataFrame, measure: str = "record_count") -> DataFrame:
    """Periods with the most and the fewest records, the earlier one on ties."""
    return trend.agg(
        F.min_by("period", F.struct((-F.col(measure)).alias("m"), "period")).alias("peak_period"),
        F.max(measure).alias("peak_count"),
        F.min_by("period", F.struct(F.col(measure).alias("m"), "period")).alias("lowest_period"),
        F.min(measure).alias("lowest_count"),
        F.count("*").alias("periods"),
    )


# --- groups and entities -------------------------------------------------------------


def group_comparison(
    df: DataFrame, group: str, metric: str, aggregation: str = "mean", k: int = 10
) -> DataFrame:
    """Count, mean, median and deviation of a metric per group, best groups first."""
    rows = df.select(C.col(group).alias("group_value"), C.col(metric).try_cast("double").alias("value")).filter(
        "group_value IS NOT NULL"
    )
    known = {
        "count": "count(value)", "mean": "avg(value)", "std": "stddev_samp(value)",
        "sum": "sum(value)", "min": "min(value)", "max": "max(value)",
    }
    shown = {a: known[a] for a in dict.fromkeys(["count", "mean", "std", aggregation]) if a in known}
    best_first = [F.desc_nulls_last(aggregation), "group_value"]
    if aggregation != "median":
        # Only the k best groups, found first, need a median.
        ranked = rows.groupBy("group_value").agg(*[F.expr(sql).alias(a) for a, sql in shown.items()])
        best = staged(ranked.orderBy(*best_first).limit(k), "best-groups")
        medians = exact_quantiles(rows.join(best.select("group_value"), "group_value", "left_semi"), ["group_value"], "value", [0.5])
        compared = best.join(medians, "group_value", "left").withColumn("median", F.col("quantiles")[0]).drop("quantiles")
        return compared.orderBy(*best_first)
    compared = exact_quantiles(rows, ["group_value"], "value", [0.5], also=shown)
    compared = compared.withColumn("median", F.col("quantiles")[0]).drop("quantiles")
    return compared.orderBy(*best_first).limit(k)


def group_extremes(compared: DataFrame, aggregation: str = "mean") -> DataFrame:
    """Best and worst of the compared groups."""
    return compared.agg(
        F.min_by("group_value", F.struct((-F.col(aggregation)).alias("m"), "group_value")).alias("best_group"),
        F.max(aggregation).alias("best_value"),
        F.max_by("group_value", F.struct((-F.col(aggregation)).alias("m"), "group_value")).alias("worst_group"),
        F.min(aggregation).alias("worst_value"),
    )


def cohort_sizes(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Distinct entities per month of their dates (an entity counts in each of its months)."""
    dated = df.filter(C.col(date).isNotNull())
    return dated.groupBy(month_label(C.col(date)).alias("cohort")).agg(
        F.count_distinct(C.col(entity)).alias("entities")
    )


def largest_cohort(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.min_by("cohort", F.struct((-F.col("entities")).alias("m"), "cohort")).alias("largest_cohort"),
        F.max("entities").alias("entities"),
        F.count("*").alias("cohorts"),
    )


def cohort_retention(df: DataFrame, entity: str, date: str, days: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """Per first-month cohort: size and share still active N or more days after the first date.

    First and last date per entity are enough, so one combined aggregation replaces a
    join of the activity with itself.
    """
    lives = (
        df.filter(C.col(date).isNotNull())
        .groupBy(C.col(entity).alias("entity"))
        .agg(F.min(C.col(date)).alias("first"), F.max(C.col(date)).alias("last"))
    )
    lasted = F.date_diff(F.col("last").cast("date"), F.col("first").cast("date"))
    return (
        lives.groupBy(month_label(F.col("first")).alias("cohort"))
        .agg(F.count("*").alias("entities"), *[F.count_if(lasted >= d).alias(f"retained_d{d}") for d in days])
        .select("*", *[F.round(F.col(f"retained_d{d}") * 100.0 / F.col("entities"), 1).alias(f"d{d}_pct") for d in days])
    )


def entity_counts(df: DataFrame, entity: str) -> DataFrame:
    known = df.filter(C.col(entity).isNotNull())
    return known.groupBy(C.col(entity).alias("entity")).agg(F.count("*").alias("activity_count"))


def top_entities(df: DataFrame, entity: str, k: int = 10) -> DataFrame:
    return entity_counts(df, entity).orderBy(F.desc("activity_count"), "entity").limit(k)


def entity_summary(df: DataFrame, entity: str) -> DataFrame:
    """Unique entities, entities seen more than once, and their share."""
    repeat = F.count_if(F.col("activity_count") > 1)
    return entity_counts(df, entity).agg(
        F.count("*").alias("unique_entities"),
        repeat.alias("repeat_entities"),
        F.round(repeat * 100.0 / F.greatest(F.count("*"), F.lit(1)), 1).alias("repeat_pct"),
    )
