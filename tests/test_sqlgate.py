import pytest
from pyspark.errors import AnalysisException

from tabwright.operators.sqlgate import RejectedSQL, safe_sql


@pytest.fixture(scope="module")
def sales(spark):
    spark.range(120_000).selectExpr("id AS order_id", "'DROP; COPY' AS note", "id * 1.5 AS total").createOrReplaceTempView("sales_data")


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("SELECT * FROM sales_data", 10_000),
        ("WITH cte AS (SELECT * FROM sales_data) SELECT * FROM cte;", 10_000),
        ("```sql\nSELECT * FROM sales_data LIMIT 10\n```", 10),
        ("SELECT * FROM sales_data LIMIT 100000", 50_000),
        ("WITH c AS (SELECT * FROM sales_data) SELECT * FROM c LIMIT 20000", 20_000),
        ("SELECT * FROM (SELECT * FROM sales_data LIMIT 30000) t", 10_000),
        ('SELECT "order_id" FROM sales_data WHERE "note" = \'DROP; COPY\' LIMIT 3', 3),
        ("SELECT order_id FROM sales_data UNION SELECT 1 INTERSECT SELECT 1", 10_000),
        ("SELECT order_id FROM sales_data EXCEPT SELECT order_id FROM sales_data", 0),
    ],
)
def test_queries_pass_with_a_limit(spark, sales, sql, rows):
    assert safe_sql(spark, sql).count() == rows


@pytest.mark.parametrize(
    "sql",
    [
        "", ";", "DROP TABLE sales_data", "DELETE FROM sales_data WHERE order_id = 1",
        "INSERT INTO sales_data VALUES (1, '2025-01-01')", "UPDATE sales_data SET total = 0",
        "CREATE TABLE hacked AS SELECT 1", "ALTER TABLE sales_data DROP COLUMN order_id",
        "COPY sales_data TO 'leak.csv'", "ATTACH 'other.db' AS other", "INSTALL httpfs", "PRAGMA database_list",
        "EXPORT DATABASE 'backup'", "SELECT * FROM sales_data; DROP TABLE sales_data;", "SHOW TABLES", "SET a = 1",
        "CACHE TABLE sales_data", "EXPLAIN SELECT 1", "WITH c AS (SELECT 1) INSERT INTO sales_data SELECT * FROM c",
        "SELECT java_method('java.lang.Math', 'abs', 1)", "SELECT (SELECT reflect('java.lang.Math', 'abs', 1))",
        "WITH c AS (SELECT java_method('java.lang.Math', 'abs', 1) AS x) SELECT * FROM c",
    ],
)
def test_everything_else_is_rejected(spark, sales, sql):
    with pytest.raises(RejectedSQL):
        safe_sql(spark, sql)


def test_unknown_columns_surface_before_any_job(spark, sales):
    with pytest.raises(AnalysisException):
        safe_sql(spark, "SELECT missing FROM sales_data")
    with pytest.raises(AnalysisException):
        safe_sql(spark, "SELECT * FROM nowhere")


def test_settings_are_left_as_found(spark, sales):
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key)
    with pytest.raises(RejectedSQL):
        safe_sql(spark, "DROP TABLE sales_data")
    assert spark.conf.get(key) == before
