"""Business questions as relational queries: filters, joins, groups, trends, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.operators import columns as C, sqlgate
from tabwright.operators.analyze import shares
from tabwright.plans.registry import Tables, register
from tabwright.sources.store import latest_per_key


def sum_to(c: str | Column, digits: int = 2) -> Column:
    return F.round(F.sum(c), digits)


def avg_to(c: str | Column, digits: int = 4) -> Column:
    return F.round(F.avg(c), digits)


def revenue_by_customer(t: Tables) -> DataFrame:
    """Line revenue per customer. Lines are summed per order first, which combines before the
    shuffle, and the join with orders reuses that partitioning."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("revenue"))
    joined = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))


def per_part(t: Tables, *measures: Column) -> DataFrame:
    """Line measures per part, before any join with the parts themselves."""
    sums = t.lineitem.groupBy("l_partkey").agg(*measures)
    return sums.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


# --- sources, projection, filters -----------------------------------------------


@register("scan_parquet", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def scan_parquet(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("q_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_project(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("q_filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount = 0")
def q_filter_cmp(t):
    kept = t.lineitem.filter((F.col("l_quantity") > 45) & (F.col("l_discount") == 0))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@register("q_filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_filter_eq(t):
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@register("q_filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(t):
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@register("q_filter_ci", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' AND lower(p_type) = 'promo'")
def q_filter_ci(t):
    kept = t.part.filter(F.col("p_name").ilike("%WIDGET%") & (F.lower("p_type") == "promo"))
    return kept.select("p_partkey", "p_name")


@register(
    "q_filter_date_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'",
)
def q_filter_date_range(t):
    day = F.col("o_orderdate")
    kept = t.orders.filter((day >= between_days("1998-07-01")) & (day < between_days("1998-10-01")))
    return kept.select("o_orderkey", "o_totalprice")


def between_days(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


# The data ends in the past, so "now" is a parameter.
AS_OF = "1998-08-15"


def period_start(unit: str, as_of: str = AS_OF, months_back: int = 0) -> Column:
    """First day of the period a date falls in, after going back some months."""
    day = F.add_months(F.lit(as_of).cast("date"), -months_back)
    return F.trunc(day, unit).cast("timestamp_ntz")


@register(
    "q_filter_this_month",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= date_trunc('month', DATE '{AS_OF}') AND o_orderdate <= DATE '{AS_OF}'",
)
def q_filter_this_month(t):
    day = F.col("o_orderdate")
    kept = t.orders.filter((day >= period_start("month")) & (day <= between_days(AS_OF)))
    return kept.select("o_orderkey", "o_totalprice")


@register(
    "q_filter_last_quarter",
    f"""SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_orderdate >= date_trunc('quarter', DATE '{AS_OF}' - INTERVAL 3 MONTH)
          AND o_orderdate < date_trunc('quarter', DATE '{AS_OF}')""",
)
def q_filter_last_quarter(t):
    day = F.col("o_orderdate")
    kept = t.orders.filter((day >= period_start("quarter", months_back=3)) & (day < period_start("quarter")))
    return kept.select("o_orderkey", "o_totalprice")


@register(
    "q_filter_yesterday",
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - INTERVAL 1 DAY AND o_orderdate < DATE '{AS_OF}'",
)
def q_filter_yesterday(t):
    today = F.lit(AS_OF).cast("date")
    day = F.col("o_orderdate")
    kept = t.orders.filter((day >= F.date_sub(today, 1).cast("timestamp_ntz")) & (day < today.cast("timestamp_ntz")))
    return kept.select("o_orderkey", "o_totalprice")


@register(
    "q_filter_null",
    """SELECT d.lang, count(*) AS documents, count(*) FILTER (WHERE l.quality IS NULL) AS unlabelled,
              count(*) FILTER (WHERE l.quality IS NOT NULL) AS labelled
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def q_filter_null(t):
    return (
        t.documents.join(t.labels, "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count("*").alias("documents"),
            F.count_if(F.col("quality").isNull()).alias("unlabelled"),
            F.count_if(F.col("quality").isNotNull()).alias("labelled"),
        )
    )


_GATED = """WITH spend AS (
  SELECT o_custkey, count(*) AS orders_placed, round(sum(o_totalprice), 2) AS total_spent
  FROM orders GROUP BY o_custkey)
SELECT "o_custkey", orders_placed, total_spent FROM spend ORDER BY total_spent DESC, o_custkey LIMIT 200"""


@register("safe_sql", _GATED)
def safe_sql(t):
    t.orders.createOrReplaceTempView("orders")
    return sqlgate.safe_sql(t.spark, f"```sql\n{_GATED};\n```")


@register(
    "apply_column_mapping",
    "SELECT c_custkey AS customer_key, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
)
def apply_column_mapping(t):
    mapping = {"c_custkey": "customer_key", "c_mktsegment": "segment", "c_acctbal": "balance"}
    return t.customer.withColumnsRenamed(mapping).select(*mapping.values())


# --- joins ----------------------------------------------------------------------


@register(
    "q_join_inner_agg_top1",
    """SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total_sales FROM orders
       JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY total_sales DESC, c_mktsegment LIMIT 1""",
)
def q_join_inner_agg_top1(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(sum_to("total").alias("total_sales"))
        .orderBy(F.desc("total_sales"), "c_mktsegment")
        .limit(1)
    )


@register(
    "q_join_multi_lookup",
    """WITH spend AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_sales FROM orders GROUP BY o_custkey),
            lead AS (SELECT c_nationkey, max_by(c_name, (c_acctbal, -c_custkey)) AS lead_name FROM customer GROUP BY c_nationkey)
       SELECT c.c_name, n.n_name, lead.lead_name, s.total_sales
       FROM spend s JOIN customer c ON s.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN lead ON c.c_nationkey = lead.c_nationkey
       ORDER BY s.total_sales DESC, c.c_name LIMIT 20""",
)
def q_join_multi_lookup(t):
    spend = t.orders.groupBy("o_custkey").agg(sum_to("o_totalprice").alias("total_sales"))
    leads = t.customer.groupBy("c_nationkey").agg(
        F.max_by("c_name", F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("lead_name")
    )
    return (
        spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(leads, "c_nationkey", "left")
        .select("c_name", "n_name", "lead_name", "total_sales")
        .orderBy(F.desc("total_sales"), "c_name")
        .limit(20)
    )


@register(
    "q_join_filter",
    """SELECT count(*) AS orders_placed, round(sum(o_totalprice), 2) AS revenue FROM orders
       JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'""",
)
def q_join_filter(t):
    per_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    joined = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.filter(F.col("c_mktsegment") == "MACHINERY").agg(
        F.sum("n").alias("orders_placed"), sum_to("total").alias("revenue")
    )


@register(
    "q_semi_having",
    """SELECT c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_balance FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000)
       GROUP BY c_mktsegment""",
)
def q_semi_having(t):
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).filter("total > 2000000")
    return (
        t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("customers"), avg_to("c_acctbal").alias("avg_balance"))
    )


@register(
    "x_scalar_broadcast",
    """SELECT event_id, value, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events""",
)
def x_scalar_broadcast(t):
    centre = t.events.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    rows = C.with_row(t.events.select("event_id", "value"), centre)
    return rows.select("event_id", "value", F.round((F.col("value") - F.col("mean")) / F.col("std"), 6).alias("z"))


# --- aggregation ------------------------------------------------------------------


@register(
    "q_agg_global",
    """SELECT count(*) AS order_count, round(sum(o_totalprice), 2) AS total_revenue, round(avg(o_totalprice), 4) AS avg_value,
              min(o_totalprice) AS min_value, max(o_totalprice) AS max_value FROM orders""",
)
def q_agg_global(t):
    return t.orders.agg(
        F.count("*").alias("order_count"),
        sum_to("o_totalprice").alias("total_revenue"),
        avg_to("o_totalprice").alias("avg_value"),
        F.min("o_totalprice").alias("min_value"),
        F.max("o_totalprice").alias("max_value"),
    )


@register(
    "q_group_sum",
    """SELECT r_name, round(sum(l_extendedprice), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY r_name ORDER BY revenue DESC""",
)
def q_group_sum(t):
    per_nation = (
        revenue_by_customer(t)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("revenue").alias("revenue"))
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        per_nation.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name")
        .agg(sum_to("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"))
    )


@register("q_group_count", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment ORDER BY customers DESC")
def q_group_count(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"))


@register(
    "q_group_avg",
    """SELECT p_type, round(avg(l_discount), 4) AS avg_discount FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY p_type ORDER BY avg_discount DESC""",
)
def q_group_avg(t):
    parts = per_part(t, F.sum("l_discount").alias("total"), F.count("l_discount").alias("lines"))
    mean = F.round(F.sum("total") / F.sum("lines"), 4)
    return parts.groupBy("p_type").agg(mean.alias("avg_discount")).orderBy(F.desc("avg_discount"))


@register(
    "q_ratio",
    "SELECT round(100.0 * count(*) FILTER (WHERE o_totalprice > 250000) / count(*), 2) AS pct_large FROM orders",
)
def q_ratio(t):
    large = F.count_if(F.col("o_totalprice") > 250000)
    return t.orders.agg(F.round(F.lit(100.0) * large / F.count("*"), 2).alias("pct_large"))


@register(
    "q_compare",
    """SELECT o_orderstatus,
              round(sum(CASE WHEN quarter(o_orderdate) = 1 THEN o_totalprice ELSE 0 END), 2) AS q1_revenue,
              round(sum(CASE WHEN quarter(o_orderdate) = 2 THEN o_totalprice ELSE 0 END), 2) AS q2_revenue
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
       GROUP BY o_orderstatus""",
)
def q_compare(t):
    day = F.col("o_orderdate")
    year = t.orders.filter((day >= between_days("1998-01-01")) & (day < between_days("1999-01-01")))
    part = lambda q: sum_to(F.when(F.quarter(day) == q, F.col("o_totalprice")).otherwise(0.0))
    return year.groupBy("o_orderstatus").agg(part(1).alias("q1_revenue"), part(2).alias("q2_revenue"))


@register(
    "q_share_of_total",
    """SELECT o_orderstatus, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct
       FROM orders GROUP BY o_orderstatus ORDER BY cnt DESC""",
)
def q_share_of_total(t):
    return (
        shares(t.orders, F.col("o_orderstatus"), "o_orderstatus")
        .withColumnRenamed("amount", "cnt")
        .orderBy(F.desc("cnt"))
    )


@register(
    "w_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate::VARCHAR AS o_orderdate, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       WHERE rn = 1""",
)
def w_latest_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    latest = latest_per_key(rows, ["o_custkey"], "o_orderdate", "o_orderkey")
    return latest.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@register(
    "w_topk_per_group",
    """SELECT c_nationkey, c_custkey, c_acctbal, rn::INTEGER AS rn FROM (
         SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
       WHERE rn <= 3""",
)
def w_topk_per_group(t):
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = t.customer.withColumn("rn", F.row_number().over(order))
    return ranked.filter("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "rn")


# --- order and top-k ----------------------------------------------------------------


@register(
    "q_topn",
    """SELECT c_name, round(sum(o_totalprice), 2) AS total_spent FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY c_name ORDER BY total_spent DESC, c_name LIMIT 5""",
)
def q_topn(t):
    spend = t.orders.groupBy("o_custkey").agg(sum_to("o_totalprice").alias("total_spent"))
    named = spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "total_spent")
    return named.orderBy(F.desc("total_spent"), "c_name").limit(5)


@register(
    "q_bottomn",
    """SELECT p_name, round(sum(l_quantity), 2) AS total_qty FROM lineitem JOIN part ON l_partkey = p_partkey
       GROUP BY p_name ORDER BY total_qty, p_name LIMIT 3""",
)
def q_bottomn(t):
    parts = per_part(t, F.sum("l_quantity").alias("qty"))
    return parts.groupBy("p_name").agg(sum_to("qty").alias("total_qty")).orderBy("total_qty", "p_name").limit(3)


@register("q_sort", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC")
def q_sort(t):
    kept = t.orders.filter("o_totalprice > 400000").select("o_orderkey", "o_totalprice")
    return kept.orderBy(F.desc("o_totalprice"))


@register("t_head", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def t_head(t):
    return t.events.select("event_id", "user_id", "event_type", "value").orderBy("event_id").limit(10)


# --- set operations -------------------------------------------------------------------


@register(
    "q_union",
    """SELECT c_nationkey AS nationkey, 'customer' AS kind, c_name AS name FROM customer
       UNION ALL SELECT s_nationkey, 'supplier', s_name FROM supplier""",
)
def q_union(t):
    customers = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    suppliers = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return customers.unionAll(suppliers)


@register("q_intersect", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).intersect(t.supplier.select("s_nationkey"))


@register("q_except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_except(t):
    finished = t.orders.filter("o_orderstatus = 'F'").select("o_custkey")
    return t.customer.select(F.col("c_custkey").alias("custkey")).subtract(finished)


_CTE = """WITH per_customer AS (
  SELECT o_custkey, count(*) AS orders_placed FROM orders GROUP BY o_custkey)
SELECT orders_placed, count(*) AS customers FROM per_customer GROUP BY orders_placed"""


@register("q_cte", _CTE)
def q_cte(t):
    return t.spark.sql(_CTE.replace("FROM orders", "FROM {orders}"), orders=t.orders)


# --- trends ----------------------------------------------------------------------------


def trend(df: DataFrame, date: str, unit: str, name: str, *measures: Column) -> DataFrame:
    bucket = F.trunc(F.col(date).cast("date"), unit) if unit != "day" else F.col(date).cast("date")
    return df.groupBy(bucket.cast("string").alias(name)).agg(*measures).orderBy(name)


@register(
    "q_trend_monthly",
    """SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, round(sum(o_totalprice), 2) AS revenue
       FROM orders GROUP BY 1 ORDER BY 1""",
)
def q_trend_monthly(t):
    return trend(t.orders, "o_orderdate", "month", "month", sum_to("o_totalprice").alias("revenue"))


@register(
    "q_trend_weekly",
    """SELECT date_trunc('week', o_orderdate)::DATE::VARCHAR AS week, count(*) AS orders_placed FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-05-15' AND o_orderdate < TIMESTAMP '1998-08-15' GROUP BY 1 ORDER BY 1""",
)
def q_trend_weekly(t):
    day = F.col("o_orderdate")
    kept = t.orders.filter((day >= between_days("1998-05-15")) & (day < between_days("1998-08-15")))
    return trend(kept, "o_orderdate", "week", "week", F.count("*").alias("orders_placed"))


@register(
    "q_trend_daily",
    """SELECT ts::DATE::VARCHAR AS day, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY 1""",
)
def q_trend_daily(t):
    return trend(t.events, "ts", "day", "day", F.count("*").alias("events"), sum_to("value").alias("total"))


@register(
    "q_trend_yearly",
    """SELECT year(first_order)::INTEGER AS year, count(*) AS new_customers FROM (
         SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) GROUP BY 1 ORDER BY 1""",
)
def q_trend_yearly(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    return first.groupBy(F.year("first_order").alias("year")).agg(F.count("*").alias("new_customers")).orderBy("year")
