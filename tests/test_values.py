import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tabwright.functions import names
from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators import analyze, charts, columns as C, profile


@pytest.mark.parametrize(
    "raw, clean",
    [("  First Name  ", "first_name"), ("Total-Amount ($)", "total_amount"), ("1st", "col_1st"), ("!!", "col"),
     ("Épée  longue", "épée_longue"), ("__a__b__", "a_b")],
)
def test_names_on_the_driver_and_in_a_column(spark, raw, clean):
    assert names.snake_name(raw) == clean
    df = spark.createDataFrame([(raw,)], "raw string").select(names.identifier(C.col("raw")))
    assert df.first()[0] == clean


@pytest.mark.parametrize(
    "file, existing, name",
    [("Sales Data 2025.csv", [], "sales_data_2025"), ("123orders.json", [], "tbl_123orders"),
     ("User-Data!#@.csv", [], "user_data"), ("Sales Data.csv", ["sales_data", "sales_data_2"], "sales_data_3"),
     ("a.csv", ["a__raw"], "a_2"), (".csv", [], "uploaded_table")],
)
def test_table_names(spark, file, existing, name):
    assert names.table_name(file, existing) == name


@given(st.lists(st.sampled_from(["a", "A", "a 2", "a_2", "a_2_2", "b!", "B", ""]), max_size=12))
def test_names_stay_unique(raw):
    assert len(set(names.unique_names(raw))) == len(raw)


def test_closest_name(spark):
    df = spark.createDataFrame([("salse_data",), ("employe",), ("zzz",)], "r string")
    got = [r[0] for r in df.select(names.closest_name(C.col("r"), ["sales_data", "employee_data", "employee"], "sales_data")).collect()]
    assert got == ["sales_data", "employee", "sales_data"]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(7)
    # A hot group of a third of the rows, ties, negatives, a constant and groups of one and two.
    groups = {"hot": rng.normal(size=15000).round(2), "wide": rng.lognormal(3, 4, 12000), "flat": np.full(500, 3.5),
              "two": np.array([1.0, 2.0]), "one": np.array([-4.0]), None: rng.integers(-9, 9, 77).astype(float)}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), None)
    df = spark.createDataFrame(pdf, "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=60), p=st.floats(0, 1))
def test_bracketed_quantile_of_any_values(spark, values, p):
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = exact_quantiles(df, ["g"], "v", [p]).first()["quantiles"][0]
    assert got == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-6)


def test_moments_equal_the_frame_library(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(5, 300), "b": rng.normal(size=300), "c": 4.0})
    pdf.loc[:40, "b"] = None
    df = spark.createDataFrame(pdf).selectExpr("a", "nullif(b, double('NaN')) AS b", "c")
    got = analyze.shape(df, ["a", "b", "c"]).toPandas().set_index("attribute")
    for c in pdf:
        assert got.loc[c, "skewness"] == pytest.approx(pdf[c].skew(), abs=1e-9)
        assert got.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurt(), abs=1e-9)
        assert got.loc[c, "variance"] == pytest.approx(pdf[c].var(), abs=1e-9)
    pairs = {(r[0], r[1]): r[2] for r in analyze.correlation_pairs(df, ["a", "b", "c"], digits=9).collect()}
    assert pairs["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-8)
    assert pairs["a", "c"] is None and pairs["b", "c"] is None


@pytest.mark.parametrize("n", [1, 2, 3])
def test_moments_of_tiny_columns(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
    row = analyze.shape(df, ["v"]).first()
    assert row["n"] == n and (n > 2 or row["skewness"] == 0.0) and row["kurtosis"] is None
    assert profile.numeric_summary(df).first()["std"] == pytest.approx(pd.Series([float(i * i) for i in range(n)]).std() if n > 1 else 0.0)


def test_correlation_of_shifted_values(spark):
    pdf = pd.DataFrame({"a": 1e9 + np.arange(1000.0), "b": 1e9 - np.arange(1000.0) ** 2})
    got = analyze.correlation_pairs(spark.createDataFrame(pdf), ["a", "b"], digits=9).first()["correlation"]
    assert got == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-8)


def test_profile_of_a_small_table(spark):
    df = spark.createDataFrame(
        [(i, "x" if i < 28 else "y", 1.0, None, [i]) for i in range(30)],
        "id bigint, kind string, one double, nothing string, nested array<int>",
    )
    rows = {r["attribute"]: r for r in profile.profile_table(df).collect()}
    assert list(rows) and "nested" not in rows
    assert rows["id"]["is_candidate_id"] and rows["id"]["sample_values"] == ["0", "1", "2", "3", "4"]
    assert rows["id"]["top_5"] == [] and rows["id"]["median"] == 14.5
    assert [tuple(t) for t in rows["kind"]["top_5"]] == [("x", 28), ("y", 2)] and rows["kind"]["min"] is None
    assert rows["one"]["is_constant"] and rows["one"]["std"] == 0.0
    assert rows["nothing"]["null_pct"] == 100.0 and rows["nothing"]["distinct_count"] == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(101)], "v double, flat double")
    rows = {(r["attribute"], r["bin"]): r["n"] for r in charts.histogram(df, ["v", "flat"]).collect()}
    assert rows["v", 20] == 6 and rows["v", 1] == 5 and rows["flat", 1] == 101
    assert sum(n for (a, _), n in rows.items() if a == "v") == 101


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, None), (2, 1)], "a int, b int")
    assert tuple(C.duplicate_rows(df).first()) == (4, 1)


def test_approximate_distinct_is_close(spark):
    df = spark.range(20000).selectExpr("id", "id % 7 AS seven")
    got = {r[0]: r[1] for r in profile.distinct(df, approximate=True).collect()}
    assert got["seven"] == 7 and abs(got["id"] - 20000) < 2500
