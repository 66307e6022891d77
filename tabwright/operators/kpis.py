"""Domain measures. Each takes the columns it needs and returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions import ordered
from tabwright.operators import columns as C
from tabwright.session import staged

# Name parts that mark the column a domain counts by.
DEPARTMENT_PARTS = ["dept", "department"]
DIAGNOSIS_PARTS = ["diag", "condition"]
CHANNEL_PARTS = ["chan", "source"]

SPIKE_Z = 2.5


def pick_column(names: Iterable[str], parts: list[str]) -> str | None:
    """First name that holds one of the parts, else the first name."""
    names = list(names)
    return next((n for n in names if any(p in n.lower() for p in parts)), names[0] if names else None)


def class_counts(df: DataFrame, column: str, k: int | None = 10) -> DataFrame:
    """Rows per class, largest first: headcount, diagnoses, acquisition channels."""
    value = C.col(column).cast("string").alias("category")
    counts = df.select(value).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "category")
    return ordered.limit(k) if k else ordered


def mean_score(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.round(F.avg(C.col(column)), 2).alias("mean_score"))


def peak_score(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(C.col(column)).alias("peak_score"))


def signal_stability(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.round(F.avg(C.col(column)), 2).alias("mean_reading"),
        F.round(F.stddev_samp(C.col(column)), 2).alias("std_reading"),
    )


def spike_share(df: DataFrame, column: str) -> DataFrame:
    """Readings more than 2.5 deviations from the mean."""
    value = C.col(column).cast("double")
    centre = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    z = F.abs(F.try_divide(F.col("v") - F.col("mean"), F.col("std")))
    rows = C.with_row(df.select(value.alias("v")).filter("v is not null"), centre)
    spikes = F.count_if(z > SPIKE_Z)
    return rows.agg(
        F.count("*").alias("readings"),
        spikes.alias("spikes"),
        F.round(F.try_divide(spikes * 100.0, F.count("*")), 2).alias("spike_pct"),
    )


def rate_by(df: DataFrame, group: str, condition: Column, name: str) -> DataFrame:
    """Share of rows that meet a condition per group: conversion, pass and win rates."""
    return df.groupBy(C.col(group).alias("group_value")).agg(
        F.count("*").alias("n"),
        F.count_if(condition).alias("hits"),
        F.round(F.count_if(condition) * 100.0 / F.count("*"), 2).alias(name),
    )


def bands(df: DataFrame, column: str, low: float, high: float, count: int) -> DataFrame:
    """Rows, mean and range per equal-width band; values outside fall into bands 0 and count+1."""
    value = C.col(column).cast("double")
    return (
        df.filter(value.isNotNull())
        .groupBy(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(count)).cast("int").alias("band"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(value), 2).alias("mean_value"),
            F.min(value).alias("low_value"),
            F.max(value).alias("high_value"),
        )
    )


def tenure(df: DataFrame, entity: str, start: str, as_of: str) -> DataFrame:
    """Entities per completed year since their first date."""
    first = df.groupBy(C.col(entity).alias("entity")).agg(F.min(C.col(start).cast("date")).alias("first"))
    years = F.floor(F.date_diff(F.lit(as_of).cast("date"), F.col("first")) / 365.25).cast("int")
    return first.groupBy(years.alias("tenure_years")).agg(F.count("*").alias("entities"))


def length_of_stay(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Days between two dates per group."""
    days = F.date_diff(C.col(end).cast("date"), C.col(start).cast("date"))
    return (
        df.select(C.col(group).alias("group_value"), days.alias("days"))
        .filter("days >= 0")
        .groupBy("group_value")
        .agg(
            F.count("*").alias("stays"),
            F.round(F.avg("days"), 2).alias("mean_days"),
            F.min("days").alias("shortest"),
            F.max("days").alias("longest"),
        )
    )


def sales(lines: DataFrame, order: str, customer: str, product: str, amount: str, k: int = 5) -> DataFrame:
    """(metric, item, value): order value, repeat purchases, top products, revenue concentration."""
    base = lines.select(
        C.col(order).alias("o"), C.col(customer).alias("c"), C.col(product).cast("string").alias("p"),
        C.col(amount).cast("double").alias("amount"),
    )
    # Every measure reads one of these two small tables, so the lines are passed over twice.
    per_order = staged(base.groupBy("o", "c").agg(F.sum("amount").alias("amount")), "orders")
    average = per_order.agg(F.round(F.avg("amount"), 2).alias("value"))
    per_customer = per_order.groupBy("c").agg(F.count("*").alias("orders"))
    repeats = per_customer.agg(F.round(F.avg(F.when(F.col("orders") > 1, 100.0).otherwise(0.0)), 2).alias("value"))
    per_product = staged(base.groupBy("p").agg(F.round(F.sum("amount"), 2).alias("revenue")), "products")
    top = per_product.orderBy(F.desc("revenue"), "p").limit(k)
    curve = staged(concentration(per_product, "p", "revenue"), "concentration")
    head = F.max(F.when(F.col("items_pct") <= 20, F.col("revenue_pct")))
    pareto = curve.agg(F.round(F.coalesce(head, F.lit(0.0)), 2).alias("value"))

    def named(df: DataFrame, metric: str, item: str | Column = "") -> DataFrame:
        label = F.lit(item) if isinstance(item, str) else item
        return df.select(F.lit(metric).alias("metric"), label.alias("item"), "value")

    return (
        named(average, "average_order_value")
        .unionByName(named(repeats, "repeat_purchase_pct"))
        .unionByName(named(top.withColumn("value", F.col("revenue")), "top_product", F.col("p")))
        .unionByName(named(pareto, "top_20pct_products_revenue_pct"))
    )


def concentration(amounts: DataFrame, item: str, amount: str) -> DataFrame:
    """The Pareto curve: items by falling amount, ties by item, with the share of all items and of the whole
    amount up to and with each. Amounts are summed as decimals of 4 digits, so the curve is exact and repeatable."""
    exact = F.col(amount).cast("decimal(28, 4)")
    rows = amounts.filter(F.col(amount).isNotNull()).select(F.col(item).alias("item"), F.col(amount).alias("amount"), exact.alias("__exact"), F.lit(1).alias("__one"))
    order = [F.col("amount").desc(), F.col("item")]
    placed = ordered.sorted_ranges(rows, order, "pareto")
    amounts_before = ordered.range_totals(placed, [], "__exact", "pareto-amounts")
    items_before = ordered.range_totals(placed, [], "__one", "pareto-items").select(
        F.col("__in").alias("__of"), F.col("before").alias("items_before"), F.col("total").alias("items")
    )
    so_far = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(amounts_before, ordered.same_range([])).join(items_before, F.col("__range") == F.col("__of"))
    rows = rows.withColumn("rank", F.col("items_before") + F.sum("__one").over(so_far)).withColumn("through", F.col("before") + F.sum("__exact").over(so_far))
    return rows.select(
        "rank", "item", "amount",
        (F.col("rank") * 100.0 / F.col("items")).alias("items_pct"),
        F.try_divide(F.col("through").cast("double") * 100.0, F.col("total").cast("double")).alias("revenue_pct"),
    )


def gini(curve: DataFrame) -> DataFrame:
    """One row: items and the Gini value of a :func:`concentration` curve, 0 where all items are equal."""
    n, whole = F.count("*"), F.sum("amount")
    by_rank = F.sum(F.col("rank") * F.col("amount"))
    return curve.agg(n.alias("items"), F.try_divide(n + 1 - 2 * by_rank / whole, n).alias("gini"))


def subscription(df: DataFrame, signup: str, cancelled: str, monthly: str, as_of: str) -> DataFrame:
    """Churn, recurring revenue of live accounts, paid split and mean lifetime in days."""
    live = C.col(cancelled).isNull()
    fee = F.coalesce(C.col(monthly).cast("double"), F.lit(0.0))
    end = F.coalesce(C.col(cancelled).cast("date"), F.lit(as_of).cast("date"))
    return df.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(~live).alias("churned"),
        F.round(F.avg(F.when(live, 0.0).otherwise(1.0)) * 100, 2).alias("churn_pct"),
        F.round(F.sum(F.when(live, fee).otherwise(0.0)), 2).alias("live_mrr"),
        F.count_if(fee > 0).alias("paid"),
        F.count_if(fee <= 0).alias("unpaid"),
        F.round(F.avg(F.date_diff(end, C.col(signup).cast("date"))), 2).alias("mean_lifetime_days"),
    )
