"""Inputs that once lost data or broke an operator."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabwright.functions.quantiles import exact_quantiles
from tabwright.operators import analyze, anomaly, classify, flow, forest, report
from tabwright.operators.sqlgate import RejectedSQL, safe_rows, safe_sql
from tabwright.plans.documents import workbook_bytes
from tabwright.sources import readers
from tabwright.sources.workbook import read_workbooks


def test_quoted_line_breaks_and_long_integers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1234567890123456789,"two\nlines"\n1234567890123456790,b\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, df.collect())) == [(1234567890123456789, "two\nlines"), (1234567890123456790, "b")]
    (tmp_path / "b.csv").write_text("id\n12345678901234567890\n12345678901234567891\n")
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).distinct().count() == 2


def test_each_json_file_has_its_own_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    (tmp_path / "b.json").write_text('{"k": 3}\n{"k": 4}\n')
    assert sorted(r[0] for r in readers.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_repeated_workbook_headers_keep_their_columns(spark):
    book = workbook_bytes(["amount", "amount", "k"], [[1, 2, "x"]])
    files = spark.createDataFrame(pd.DataFrame({"path": ["a.xlsx"], "content": [book]}))
    df = read_workbooks(files)
    assert df.columns == ["amount", "amount.1", "k"] and tuple(df.first()) == ("1", "2", "x")


def test_correlation_and_scores_survive_odd_numbers(spark):
    rows = [(float(i), float(i), 1e308 if i % 2 else -1e308) for i in range(40)] + [(float("nan"), 1.0, 1e308), (2.0, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r["col1"], r["col2"]): r["correlation"] for r in analyze.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == 1.0
    assert anomaly.zscore(df, ["a", "b", "c"]).count() == 42


def test_gate_opens_no_files(spark):
    with pytest.raises((RejectedSQL, AnalysisException)):
        safe_sql(spark, "SELECT * FROM text.`/etc/hostname`")


def test_quantiles_need_no_luck_with_values_or_keys(spark):
    """Heavy tails, one hot value, a cluster far from zero, signs, null and constant keys, no broadcasts."""
    rng = np.random.default_rng(5)
    parts = [rng.normal(0, 1, 400), rng.lognormal(0, 8, 300), np.full(500, 7.0), 1e9 + rng.random(300) * 1e-3, [0.0, 5e-324, -1e308, 1e308]]
    values = np.concatenate(parts)
    pdf = pd.DataFrame({"g": rng.choice(["a", None, "hot", "hot"], len(values)), "v": values})
    df, probs = spark.createDataFrame(pdf), [0.0, 0.25, 0.5, 0.95, 1.0]
    found = exact_quantiles(df, ["g"], "v", probs, also={"m": "count(value)"})
    got = {r["g"]: (r["quantiles"], r["m"]) for r in found.collect()}
    for key, part in pdf.groupby("g", dropna=False):
        cuts, n = got[key if isinstance(key, str) else None]
        assert np.allclose(cuts, np.quantile(part["v"], probs), rtol=1e-12) and n == len(part)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = exact_quantiles(df.select(F.lit(1).alias("k"), "v"), ["k"], "v", [0.95])
        assert np.isclose(one.first()["quantiles"][0], np.quantile(values, 0.95), rtol=1e-12)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,), (float("-inf"),)], "v double")
    assert [str(x) for x in exact_quantiles(odd, [], "v", [0.0, 1.0]).first()["quantiles"]] == ["-inf", "nan"]
    assert exact_quantiles(df.filter("false"), ["g"], "v", probs).count() == 0


def test_cut_answers_say_so(spark):
    spark.range(30).createOrReplaceTempView("thirty")
    for limit, cut in ((10, True), (30, False), (31, False)):
        rows, marked = safe_rows(spark, "SELECT * FROM thirty", default=limit)
        assert rows.count() == min(limit, 30) and marked is cut
    answer = flow.question_result(spark, "none", "SELECT * FROM thirty WHERE id < 0")
    assert answer.rows.count() == answer.alert.count() == answer.alert_rows.count() == 0 and not answer.cut


@pytest.mark.parametrize("rows", [40, 3000])
def test_forest_flags_what_lies_above_its_threshold(spark, rows):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (rows, 2))
    x[0] = [60, -60]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    scored = forest.isolation_forest(df, ["a", "b"]).toPandas()
    cut = np.quantile(scored["anomaly_score"], 0.95)
    assert len(scored) == rows and (scored["is_anomaly"] == (scored["anomaly_score"] > cut)).all()
    assert scored["anomaly_score"].between(0, 1).all()
    assert scored.loc[scored["anomaly_score"].idxmax(), "a"] == 60


def test_forest_samples_about_as_many_rows_as_asked(spark):
    df = spark.range(20_000).selectExpr("double(id) AS a")
    grown = forest.fit(df, ["a"], 20_000, trees=40, sample=200)
    sizes = [int(part["size"].iloc[0]) for part in grown.values()]
    assert len(sizes) == 40 and 180 < np.mean(sizes) < 220 and min(sizes) > 120
    whole = forest.fit(df.limit(100), ["a"], 100, trees=5, sample=200)
    assert [int(part["size"].iloc[0]) for part in whole.values()] == [100] * 5


def test_no_column_is_left_out_silently(spark):
    wide = spark.createDataFrame([tuple(range(i, i + 9)) for i in range(60)], ", ".join(f"c{i} int" for i in range(9)))
    names = wide.columns
    assert analyze.distribution(wide, names).count() == 9 and analyze.distribution(wide, names, most=5).count() == 5
    assert analyze.value_frequency(wide, names).count() == 9
    roles = spark.createDataFrame(
        [("t", f"g{i}", i, "categorical", 90, 10.0 + i) for i in range(6)],
        "table_name string, attribute string, position int, role string, row_count long, missing_pct double",
    )
    assert len(classify.classify_dataset(roles).first()["group_columns"]) == 6
    none = spark.createDataFrame([(0,)], "duplicate_rows long")
    said = report.limitations(roles, none, "g0").filter("position = 1").first()["limitation"]
    assert all(f"g{i} (" in said for i in range(6))
    said = report.limitations(roles, none, "g0", most=4).filter("position = 1").first()["limitation"]
    assert said.endswith("g3 (13.0%) and 2 more.")


def test_report_names_its_columns_outliers_and_drivers(spark, store):
    rows = [(i, f"g{i % 3}", f"k{i % 4}", float(i % 17), 900.0 if i == 7 else float(i % 5), f"2024-0{1 + i % 9}-05T10:00:00Z") for i in range(120)]
    df = spark.createDataFrame(rows, "row_id int, kind string, class string, amount double, price double, created_at string")
    done = flow.auto_analysis(df, "facts", store)
    assert dict(done.clean.dtypes)["created_at"] == "timestamp_ntz"
    records = {}
    for r in done.sections.filter("record IS NOT NULL").collect():
        records.setdefault(r["section"], []).append(json.loads(r["record"]))
    summary = records["outlier_detection"][0]
    assert len(summary["primary_drivers"]) == 2 and summary["anomaly_count"] > 0
    assert records["flagged_rows"][0]["price"] == 900.0 and len(records["flagged_rows"]) <= 10
    assert {r["of_columns"][0] for r in records["group_comparison"]} >= {"kind", "class"}
    assert all(r["of_columns"] for r in records["time_trend_analysis"])
