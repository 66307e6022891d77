"""Sketches that merge, version numbers under two writers, running totals and the Pareto curve."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import ordered
from tabwright.operators import kpis, profile, sketches
from tabwright.sources.store import Store


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(1)
    rows = [(i % 900, rng.choice(["hot"] * 3 + [f"v{j}" for j in range(2000)]), 1e6 + rng.gauss(0, 1), None if i % 7 else float("nan"), "x" * 300) for i in range(12_000)]
    return spark.createDataFrame(rows, "id long, label string, value double, holes double, long string")


def by_name(df):
    return {r["attribute"]: r for r in df.collect()}


def test_sketches_of_parts_equal_that_of_the_whole(spark, readings):
    parts = [sketches.sketch_table(readings.filter(F.pmod("id", F.lit(4)) == i)) for i in range(4)]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    merged = by_name(sketches.read_sketches(sketches.merge_sketches(stored)))
    whole = by_name(sketches.read_sketches(sketches.sketch_table(readings)))
    summary = by_name(profile.numeric_summary(readings))
    distinct = by_name(profile.distinct(readings))
    for c in readings.columns:
        a, b = merged[c], whole[c]
        assert (a["rows"], a["n"], a["low"], a["high"], a["dtype"], a["position"]) == (b["rows"], b["n"], b["low"], b["high"], b["dtype"], b["position"])
        assert a["distinct_count"] == pytest.approx(distinct[c]["distinct_count"], rel=4 * sketches.DISTINCT_ERROR, abs=1)
        if c in ("id", "value"):
            assert a["mean"] == pytest.approx(summary[c]["mean"]) and a["std"] == pytest.approx(summary[c]["std"], rel=1e-6)
            values = np.sort([r[0] for r in readings.select(c).collect()])
            for p, q in zip((0.25, 0.5, 0.75), a["quantiles"]):
                below, upto = np.searchsorted(values, q, "left") / len(values), np.searchsorted(values, q, "right") / len(values)
                assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR
    assert merged["holes"]["quantiles"] is None and merged["holes"]["mean"] is None


def test_frequent_values_come_back(readings):
    found = by_name(sketches.read_sketches(sketches.sketch_table(readings), k=3))
    n = readings.filter("label = 'hot'").count()
    assert (found["label"]["top"][0]["value"], found["label"]["top"][0]["n"]) == ("hot", n)
    (shown,) = found["long"]["top"]
    assert shown["n"] == 12_000 and len(shown["value"]) < 64


def test_a_growing_table_is_profiled_from_its_sketches(spark, store, readings):
    for i in range(3):
        assert store.append_sketches("r", readings.filter(F.pmod("id", F.lit(3)) == i)) == i + 1
    found = store.sketched_profile("r")
    assert all("_column_sketches" in f for f in found.inputFiles())
    assert by_name(found)["id"]["rows"] == 12_000
    assert by_name(store.sketched_profile("r", versions=[1, 2]))["id"]["rows"] == 8_000
    extra = spark.createDataFrame([(1, "new")], "id long, added string")
    store.append_sketches("r", extra)
    grown = by_name(store.sketched_profile("r"))
    assert grown["id"]["rows"] == 12_001 and grown["added"]["rows"] == 1


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "a int, b string")
    assert sketches.sketch_table(none).count() == 0
    nulls = by_name(sketches.read_sketches(sketches.sketch_table(spark.sql("SELECT CAST(NULL AS INT) AS a, CAST(NULL AS STRING) AS b"))))
    assert nulls["a"]["n"] == 0 and nulls["a"]["distinct_count"] == 0 and list(nulls["b"]["top"]) == []


def test_two_writers_get_versions_of_their_own(spark, store):
    other = Store(spark, store.root)
    with ThreadPoolExecutor(8) as pool:
        got = [f.result() for f in [pool.submit((store, other)[i % 2].claim_version, "t") for i in range(40)]]
    assert sorted(got) == list(range(1, 41))
    reports = spark.createDataFrame([("t", 1), ("u", 2)], "table_name string, rows_clean bigint")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda s: s.append_report(reports), [store, other]))
    log = sorted((r["table_name"], r["version"]) for r in store.read("_dataset_reports").collect())
    assert log == [("t", 41), ("t", 42), ("u", 1), ("u", 2)]


def test_claims_follow_versions_from_before(spark, store):
    old = spark.createDataFrame([("t", 1, 5), ("t", 2, 5)], "table_name string, version int, rows_clean bigint")
    store.append("_dataset_reports", old)
    store.append_report(spark.createDataFrame([("t", 9)], "table_name string, rows_clean bigint"))
    assert sorted(r["version"] for r in store.read("_dataset_reports").collect()) == [1, 2, 3]


@pytest.fixture
def small_ranges(spark):
    """Several ranges even for small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals_over_ranges(spark, small_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int, n int")
    got = ordered.running_total(df, ["g"], [F.col("v").desc(), F.col("i")], "n").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["v"], r["i"]))
        assert [r["through"] for r in own] == list(np.cumsum([r["n"] for r in own]))
        assert {r["total"] for r in own} == {sum(r["n"] for r in own)}
    assert len(got) == 500
    assert len({r[0] for r in ordered.sorted_ranges(df, [F.col("v"), F.col("i")], "t").select("__range").collect()}) > 3
    assert ordered.running_total(df.limit(0), [], [F.col("v")], "n").count() == 0


def test_pareto_curve_and_gini(spark, small_ranges):
    rng = random.Random(5)
    amounts = [round(rng.paretovariate(1.2), 2) for _ in range(300)] + [0.0] * 5 + [2.5] * 20
    df = spark.createDataFrame([(f"p{i}", a) for i, a in enumerate(amounts)] + [("null", None)], "p string, a double")
    curve = kpis.concentration(df, "p", "a")
    got = sorted(curve.collect(), key=lambda r: r["rank"])
    want = sorted(((f"p{i}", a) for i, a in enumerate(amounts)), key=lambda x: (-x[1], x[0]))
    assert [(r["item"], r["amount"]) for r in got] == want
    assert [r["revenue_pct"] for r in got] == pytest.approx(list(np.cumsum([a for _, a in want]) * 100 / sum(amounts)))
    assert [r["items_pct"] for r in got] == pytest.approx([100 * (i + 1) / len(amounts) for i in range(len(amounts))])
    x = np.array(amounts)
    pairs = np.abs(x[:, None] - x[None, :]).sum() / (2 * len(x) ** 2 * x.mean())
    assert kpis.gini(curve).first()["gini"] == pytest.approx(pairs)
    equal = spark.range(10).selectExpr("id AS p", "3D AS a")
    assert kpis.gini(kpis.concentration(equal, "p", "a")).first()["gini"] == pytest.approx(0)
    assert kpis.concentration(df.limit(0), "p", "a").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_over_ranges(spark, small_ranges, hot):
    from tabwright.functions.quantiles import exact_quantiles

    rng = random.Random(7)
    rows = [(None if i % 11 == 0 else i % 3, 5.0 if hot and i % 3 else rng.choice([rng.gauss(0, 1e9), rng.random(), -0.0, 7.0])) for i in range(3000)]
    rows += [(9, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in {k for k, _ in rows}}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], probs), rel=1e-12, abs=1e-12)


def test_quantiles_take_few_exchanges(spark):
    """Of all combined rows: one to combine them and one to sort them, both written; the rest is picked from that."""
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    plan = profile.numeric_summary(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7 and plan.count("Exchange") <= 11
