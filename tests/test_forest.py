"""The isolation forest's draw and its exact attribution, against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tabwright.operators import forest

COLUMNS = ["a", "b", "c", "d"]


def grown(rng, trees=5, rows=40, columns=4):
    return {t: forest._grow(t, np.round(rng.normal(0, 1, (rows, columns)), 1)) for t in range(trees)}


def expected(part, x, known):
    """A tree's path length when only some columns are known: other splits are averaged by their sampled rows."""
    rows = part.set_index("node")

    def at(node):
        r = rows.loc[node]
        f = int(r["feature"])
        if f < 0:
            return float(r["path"])
        below, above = int(r["below"]), int(r["above"])
        if f in known:
            return at(below if x[f] <= r["cut"] else above)
        return (at(below) * rows.at[below, "size"] + at(above) * rows.at[above, "size"]) / r["size"]

    return at(0)


def by_subsets(model, x, scale):
    value = lambda known: -sum(expected(p, x, known) for p in model.values()) / len(model) / scale
    out, n = [], len(x)
    for f in range(n):
        others = [i for i in range(n) if i != f]
        out.append(
            sum(
                math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value({*s, f}) - value(set(s)))
                for k in range(n)
                for s in itertools.combinations(others, k)
            )
        )
    return out, value(set()), value(set(range(n)))


def test_shapley_values_equal_all_subsets():
    rng = np.random.default_rng(3)
    model = grown(rng)
    leaves, base = forest.leaves_of(model, 2.5)
    x = np.vstack([np.round(rng.normal(0, 1, (15, 4)), 1), [[9, 9, 9, 9]], [[0, 0, -9, 0]]])
    got = forest.shapley_values(x, leaves)
    for row, credit in zip(x, got):
        want, none, whole = by_subsets(model, row, 2.5)
        assert credit == pytest.approx(want, abs=1e-10)
        assert base == pytest.approx(none) and base + credit.sum() == pytest.approx(whole)


def test_a_column_that_splits_nothing_gets_nothing():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (50, 3))
    x[:, 1] = 7.0
    leaves, _ = forest.leaves_of({0: forest._grow(0, x)}, 1.0)
    assert (forest.shapley_values(x, leaves)[:, 1] == 0).all()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (2000, 2)), 2)
    rows = [(float(a), float(b)) for a, b in x] + [(0.5, 0.5)] * 1000 + [(50.0, -50.0)] * 3 + [(None, 0.0), (-0.0, None)]
    return spark.createDataFrame(rows, "a double, b double")


def scores(df):
    return sorted(((r["a"], r["b"], r["anomaly_score"], r["is_anomaly"], tuple(r["contributions"])) for r in df.collect()), key=str)


def test_scores_do_not_depend_on_the_layout(table):
    one = scores(forest.isolation_forest(table.coalesce(1), ["a", "b"]))
    many = scores(forest.isolation_forest(table.repartition(50), ["a", "b"]))
    assert one == many
    assert one[0][2] and any(r[3] for r in one if r[0] == 50.0)


def test_contributions_add_up(table):
    rows = forest.isolation_forest(table, ["a", "b"]).collect()
    for r in rows:
        assert math.log2(r["expected_score"]) + sum(r["contributions"]) == pytest.approx(math.log2(r["anomaly_score"]), abs=1e-9)


def test_hot_rows_are_drawn_in_proportion(spark):
    hot = spark.range(60_000).selectExpr("IF(id < 20000, 1D, CAST(id AS DOUBLE)) AS v")
    drawn = forest.drawn_rows(hot, ["v"], 60_000, 60, 100).toPandas()
    lowest = drawn.sort_values("order").groupby("tree").head(100)
    per_tree = lowest.groupby("tree").size()
    assert len(per_tree) == 60 and (per_tree == 100).all()
    share = (lowest["x"].map(lambda v: v[0]) == 1.0).mean()
    assert abs(share - 1 / 3) < 0.03
    others = lowest[lowest["x"].map(lambda v: v[0]) != 1.0]["x"].map(lambda v: v[0])
    assert others.nunique() > 3500  # no other row is drawn much more often than its chance
    assert abs(others.mean() - 40_000) < 700


def test_numbers_of_copies_are_those_of_uniform_draws():
    rng = np.random.default_rng(9)
    counts = [len(list(forest._lowest(np.random.default_rng([1, i]), 400, 0.01, False))) for i in range(3000)]
    assert np.mean(counts) == pytest.approx(4, abs=0.15) and np.var(counts) == pytest.approx(3.96, rel=0.12)
    some = [list(forest._lowest(np.random.default_rng([2, i]), 50, 0.01, True)) for i in range(3000)]
    binomial = rng.binomial(50, 0.01, 200_000)
    assert min(map(len, some)) == 1 and np.mean([len(s) for s in some]) == pytest.approx(binomial[binomial > 0].mean(), rel=0.05)
    assert all(s == sorted(s) and s[-1] < 0.01 for s in some)
    assert len(list(forest._lowest(np.random.default_rng(0), 7, 1.0, False))) == 7


def test_few_rows_and_no_rows(spark):
    few = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert forest.isolation_forest(few, ["a", "b"]).filter("is_anomaly OR anomaly_score IS NOT NULL").count() == 0
    same = forest.isolation_forest(few, ["a", "b"], min_rows=2).collect()
    assert len({r["anomaly_score"] for r in same}) == 1 and not any(r["is_anomaly"] for r in same)
    assert all(list(r["contributions"]) == [0.0, 0.0] for r in same)
    assert isinstance(forest.leaves_of({}, 1.0)[1], float) and pd.DataFrame().empty


@pytest.mark.parametrize("columns", [1, 2, 3, 4])
def test_step_tables_equal_the_leaf_tables(columns):
    rng = np.random.default_rng(7)
    model = grown(rng, trees=6, columns=columns)
    x = np.vstack([np.round(rng.normal(0, 1, (60, columns)), 1), np.full((1, columns), 9.0), np.full((1, columns), -9.0)])
    leaves, expected = forest.leaves_of(model, 2.5)
    steps = forest.steps_of(model, 2.5, columns)
    want = forest.shapley_values(x, leaves)
    got = forest.credits_by_steps(x, steps, expected + want.sum(axis=1))
    assert got == pytest.approx(want, abs=1e-12) and steps.expected == expected
    assert (forest.steps_of(model, 2.5, columns, most=0) is None) == (columns > 2)


def test_a_table_in_one_split_is_scored_by_several_tasks(spark, monkeypatch):
    from tabwright import session

    monkeypatch.setattr(session, "SMALL_BYTES", 0)  # as if the split were of a large file
    one = spark.createDataFrame([(float(i % 37), float(i % 11)) for i in range(3000)], "a double, b double").coalesce(1)
    scored = forest.isolation_forest(one, ["a", "b"], trees=5)
    assert scored.count() == 3000
    assert len({f for f in scored.inputFiles()}) > 1
