import datetime
import json

import numpy as np
import pandas as pd
import pytest

from tabwright.operators import analyze, anomaly, classify, flow, forest, kpis, profile, report
from tabwright.operators import columns as C
from tabwright.sources import readers, store as S


@pytest.fixture(scope="module")
def accounts(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        (
            f"CUST_{i}", str(day + datetime.timedelta(days=i)),
            str(day + datetime.timedelta(days=2 * i)) if i % 3 == 0 else None,
            "active" if i % 3 else "canceled", 49.0 + (i % 5) * 10, "Basic" if i % 2 == 0 else "Pro",
        )
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows, "customer_id string, signup_date string, cancellation_date string, status string, mrr double, plan string"
    )


def test_roles_of_accounts(accounts):
    roles = {r["attribute"]: r["role"] for r in profile.profile_roles(accounts).collect()}
    assert roles == {
        "customer_id": "id", "signup_date": "datetime", "cancellation_date": "datetime", "status": "categorical",
        "mrr": "numeric", "plan": "categorical",
    }
    assert profile.quality_score_v1(accounts).first()["score"] == pytest.approx(100 - 0.4 * 66 / 6 - 3.0, abs=0.05)


def test_plan_for_accounts(accounts):
    roles = flow.with_table_name(profile.profile_roles(accounts), "accounts")
    found = classify.classify_dataset(roles).first()
    assert (found["dataset_type"], found["key_entity"], found["id_column"]) == ("subscription", "customer", "customer_id")
    tasks = [r["task"] for r in classify.plan_tasks(roles).orderBy("position").collect()]
    assert tasks == [
        "descriptive_stats", "distribution_analysis", "outlier_detection", "value_frequency", "time_trend_analysis",
        "status_breakdown", "cohort_retention", "entity_aggregation", "group_comparison", "cross_tabulation",
        "domain_subscription_kpis",
    ]


def test_whole_analysis_of_accounts(accounts, store):
    done = flow.auto_analysis(accounts, "accounts", store)
    assert done.title == "Auto-Analysis Report: Subscription Data (Customer Level)"
    sections = {}
    for r in done.sections.collect():
        sections.setdefault(r["section"], []).append(r)
    assert not [r for rows in sections.values() for r in rows if r["skip_reason"]]
    metrics = json.loads(sections["key_metrics"][0]["record"])
    assert (metrics["total_records"], metrics["total_columns"], metrics["records_text"]) == (100, 5, "100")
    kpi = json.loads(sections["domain_subscription_kpis"][0]["record"])
    assert kpi["accounts"] == 100
    assert done.clean.count() == 100 and store.read("accounts__raw").count() == 100


def test_a_failing_section_is_kept_with_its_reason(spark, store):
    # A sensor table whose only reading column is text throughout has no number to measure.
    df = spark.createDataFrame([(f"d{i % 3}", f"s{i % 4}") for i in range(40)], "device string, sensor_state string")
    rows = flow.auto_analysis(df, "devices", store).sections.filter("skip_reason IS NOT NULL").collect()
    assert [(r["section"], r["skip_reason"]) for r in rows] == [
        ("domain_sensor_kpis", "No column fits the domain measures.")
    ]


def test_file_to_versioned_report(spark, store, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        "Order ID,order_date, Total Amount ,notes\n"
        + "".join(f"{i},2025-01-{i % 28 + 1:02d},{i * 1.5},\n" for i in range(1, 61))
        + "60,2025-01-05,90.0,\n,,,\nodd\n"
    )
    for _ in range(2):
        clean = flow.load_file(store, str(path), "sales")
    assert clean.columns == ["order_id", "order_date", "total_amount"] and clean.count() == 61
    latest = S.report_get(store.read("_dataset_reports")).first()
    assert latest["version"] == 2 and latest["rows_raw"] == 63 and latest["rows_clean"] == 61
    assert latest["domain"]["domain"] == "Sales" and len(latest["domain"]["suggested_questions"]) == 5
    assert [p["attribute"] for p in latest["profile"]] == clean.columns
    assert latest["quality"]["clean_score"] > latest["quality"]["raw_score"]


@pytest.mark.parametrize(
    "columns, domain",
    [
        (["order_id", "product_name", "unit_price", "quantity"], "Sales"),
        (["employee_id", "name", "department", "salary"], "HR"),
        (["patient", "ward"], "Healthcare"), (["iban", "balance"], "Finance"), (["campaign", "spend"], "Marketing"),
        (["warehouse", "units"], "Inventory"), (["student", "mark"], "Education"), (["foo", "bar"], "Other"),
    ],
)
def test_domains(spark, columns, domain):
    df = spark.createDataFrame([tuple("x" for _ in columns)], columns)
    found = classify.classify_domain(S.catalog({"t": df})).first()
    assert found["domain"] == domain and len(found["suggested_questions"]) == 5 and found["row_count"] == 1


def test_whole_words_do_not_match_inside_others(spark):
    df = spark.createDataFrame([(1, 2)], "download bigint, weight bigint")
    catalog = S.catalog({"t": df})
    assert classify.classify_domain(catalog).first()["domain"] == "Marketing"
    assert classify.classify_domain(catalog, whole_words=True).first()["domain"] == "Other"


def test_trend_picks_weeks_or_months(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-03-30')) AS d")
    weekly = analyze.time_trend(days, "d")
    assert weekly.count() == 13 and weekly.orderBy("period").first()["period"] == "2024-01-01/2024-01-07"
    longer = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-03-31')) AS d")
    assert [tuple(r) for r in analyze.time_trend(longer, "d").orderBy("period").collect()] == [
        ("2024-01", 31), ("2024-02", 29), ("2024-03", 31),
    ]
    extremes = analyze.peak_and_low(analyze.time_trend(longer, "d")).first()
    assert (extremes["peak_period"], extremes["lowest_period"]) == ("2024-01", "2024-02")


def test_groups_compare_like_the_frame_library(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(list("abcdefghijklm"), 600), "v": rng.normal(size=600)})
    expected = pdf.groupby("g")["v"].agg(["count", "mean", "median", "std"]).sort_values("mean", ascending=False).head(10)
    for by in ("mean", "median"):
        got = analyze.group_comparison(spark.createDataFrame(pdf), "g", "v", aggregation=by).toPandas().set_index("group_value")
        wanted = pdf.groupby("g")["v"].agg(["count", "mean", "median", "std"]).sort_values(by, ascending=False).head(10)
        assert list(got.index) == list(wanted.index)
        np.testing.assert_allclose(got[["mean", "median", "std"]], wanted[["mean", "median", "std"]])
    assert len(expected) == 10


def test_planted_outlier_leads_both_detectors(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s1": rng.normal(11, 1, 400), "s2": rng.normal(5, 0.2, 400)})
    pdf.loc[17, "s1"] = 100.2
    df = spark.createDataFrame(pdf.reset_index().rename(columns={"index": "row"}))
    for scored in (anomaly.zscore(df, ["s1", "s2"]), forest.isolation_forest(df, ["s1", "s2"])):
        top = scored.orderBy(scored["anomaly_score"].desc()).first()
        assert top["row"] == 17 and top["is_anomaly"] and top["drivers"][0] == "s1"
    share = anomaly.summary(forest.isolation_forest(df, ["s1", "s2"])).first()
    assert share["anomaly_count"] == 20 and share["anomaly_pct"] == 5.0
    assert forest.attribution(forest.isolation_forest(df, ["s1", "s2"]), ["s1", "s2"]).count() == 2


def test_forest_on_a_table_of_mostly_one_row(spark):
    df = spark.sql("SELECT if(id % 3 = 0, id * 1.0D, 7.0D) AS v FROM range(120000)")
    scored = forest.isolation_forest(df, ["v"])
    assert 0 < anomaly.summary(scored).first()["anomaly_count"] <= 6000


@pytest.mark.parametrize("rows", [0, 5])
def test_too_few_rows_flag_nothing(spark, rows):
    df = spark.createDataFrame([(float(i), None) for i in range(rows)], "v double, w double")
    for scored in (anomaly.zscore(df), forest.isolation_forest(df)):
        assert not anomaly.summary(scored).first()["has_anomaly"]
        assert anomaly.alert(scored, "q").count() == 0


def test_alert_of_constant_and_infinite_values(spark):
    df = spark.createDataFrame([(1.0, float("inf") if i == 3 else None, 0.0 if i else 50.0) for i in range(40)], "a double, b double, c double")
    scored = anomaly.zscore(df)
    head = anomaly.alert(scored, "q").first()
    assert head["anomaly_count"] == 1 and head["explanation"].startswith("Column ")
    assert json.loads(anomaly.alert_rows(scored, "q").first()["record"])["c"] == 50.0


def test_limitations_of_a_small_sparse_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "v int, w string")
    texts = [r["limitation"] for r in report.limitations(profile.profile_roles(df), C.duplicate_rows(df)).orderBy("position").collect()]
    assert texts == [
        "Columns with >5% missing values detected: w (66.67%).",
        "1 duplicate rows detected prior to cleaning step.",
        "No datetime columns detected; longitudinal and cohort retention analyses were skipped.",
        "No unique entity ID column identified; entity-level aggregation was skipped.",
        "Small dataset sample size (3 rows); statistical findings should be interpreted with caution.",
    ]


def test_bands_and_stays(spark):
    df = spark.sql("SELECT * FROM VALUES (-1.0), (0.0), (99.9), (100.0) AS t(v)")
    assert {r["band"]: r["n"] for r in kpis.bands(df, "v", 0, 100, 4).collect()} == {0: 1, 1: 1, 4: 1, 5: 1}


def test_read_any_of_missing_values_feeds_roles(spark, tmp_path):
    (tmp_path / "t.csv").write_text("flag,when\n" + "".join(f"{'Yes' if i % 2 else 'no'},{i % 12 + 1}/{i % 28 + 1}/2024\n" for i in range(30)))
    roles = profile.profile_roles(readers.read_any(spark, str(tmp_path / "t.csv"))).collect()
    assert {r["attribute"]: r["role"] for r in roles} == {"flag": "boolean", "when": "datetime"}
