"""Plan properties that matter on large tables, and behaviour on skewed keys."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tabwright.operators import analyze, columns as C, profile
from tabwright.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that run jobs of their own while being built have their own tests.
LAZY = [n for n in contract.queries() if n.startswith(("q_", "w_", "x_", "agg_", "an_", "kpi_", "chart_", "fn_", "report_"))]


@pytest.mark.parametrize("name", sorted(set(LAZY) - {"report_build"}))
def test_no_cross_join_and_no_window_over_everything(spark, name):
    plan = plan_of(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert all("windowspecdefinition(specifiedwindowframe" not in w.replace(" ", "") for w in windows)


def test_scans_read_only_what_is_asked(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(t.lineitem.groupBy("l_returnflag").count())
    assert "ReadSchema: struct<l_returnflag:string>" in plan
    dated = plan_of(contract.queries()["q_filter_date_range"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in dated
    few = plan_of(profile.numeric_summary(t.lineitem, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in few


def test_top_values_are_limited_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(C.top_values(C.value_counts(t.orders, ["o_custkey"]), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_profile_shares_one_shuffle_of_value_counts(spark):
    t = Tables(spark, FOLDER)
    df = profile.profile_table(t.orders)
    df.collect()
    assert plan_of(df).split("Initial Plan")[0].count("ReusedExchange") >= 2


def test_one_row_facts_are_computed_once(spark):
    t = Tables(spark, FOLDER)
    facts = t.orders.selectExpr("avg(o_totalprice) AS a", "max(o_totalprice) AS b", "min(o_totalprice) AS c")
    plan = plan_of(C.with_row(t.orders.select("o_orderkey"), facts))
    assert plan.count("FileScan") == 2


def test_profile_plan_does_not_grow_with_the_rows(spark):
    wide = spark.range(100).selectExpr(*[f"id * {i} AS c{i}" for i in range(120)], *[f"string(id % {i + 1}) AS s{i}" for i in range(60)])
    found = profile.profile_roles(wide)
    assert found.count() == 180


def test_groups_of_one_hot_key(spark):
    """A third of the rows share one key, one value and one whole row."""
    df = spark.range(300_000).selectExpr(
        "if(id % 3 = 0, 'hot', string(id)) AS k", "if(id % 3 = 0, 1.0D, id * 0.5D) AS v", "timestamp_ntz'2024-01-01' AS d"
    )
    assert tuple(C.duplicate_rows(df).first()) == (300_000, 99_999)
    top = analyze.top_entities(df, "k").first()
    assert (top["entity"], top["activity_count"]) == ("hot", 100_000)
    assert analyze.entity_summary(df, "k").first()["repeat_entities"] == 1
    best = analyze.group_comparison(df, "k", "v", aggregation="count").first()
    assert (best["group_value"], best["count"], best["median"]) == ("hot", 100_000, 1.0)


def test_python_workers_need_no_copy_of_the_package(tmp_path):
    """Tasks run where only Spark and the numeric libraries are installed."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tabwright.session import build_session
import __spark_entry__ as contract
spark = build_session("far", "local[2]", spark__sql__shuffle__partitions="2")
for name in ("scan_excel", "anomaly_iforest"):
    assert contract.queries()[name](spark, {FOLDER!r}).count() > 0
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
