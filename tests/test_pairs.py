"""Correlations from blocks of co-moments against numpy, pair by pair."""

import numpy as np
import pytest

from tabwright.operators import analyze, pairs


def frame(spark, x):
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`c {i}` double" for i in range(x.shape[1]))).repartition(5)


def by_hand(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return int(both.sum()), None
    return int(both.sum()), float(np.corrcoef(a, b)[0, 1])


def test_pairs_with_holes_and_far_middles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "ROWS", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 11))
    x[:, 1] += 0.7 * x[:, 0]
    x[:, 2] = 1e9 + x[:, 0] * 1e-1
    x[:, 3] = 0.1  # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    x[:, 5] = np.where(np.arange(300) == 7, 3.0, np.nan)
    x[:, 6] = np.where(np.arange(300) < 150, 5.0, x[:, 6])
    x[:, 7] = np.where(np.arange(300) < 150, x[:, 7], np.nan)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in pairs.correlations(frame(spark, x), [f"c {i}" for i in range(11)]).collect()}
    assert set(got) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
    for (i, j), (n, r) in got.items():
        want = by_hand(x, i, j)
        assert n == want[0] and (r is None) == (want[1] is None) and (r is None or r == pytest.approx(want[1], abs=1e-5)), (i, j)


def test_infinities_are_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (2D, 4D), (double('Infinity'), 1D), (3D, double('NaN')), (4D, 8.5D) AS t(a, b)")
    (r,) = pairs.correlations(df, ["a", "b"]).collect()
    assert r["n"] == 3 and r["r"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 8.5])[0, 1])
    assert pairs.correlations(df.limit(0), ["a", "b"]).count() == 0


def test_a_thousand_columns_take_one_scan(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 1000))
    x[:, 999] = -x[:, 0]
    text = spark.createDataFrame([([float(v) for v in row],) for row in x], "x array<double>")
    wide = text.selectExpr(*[f"x[{i}] AS c{i}" for i in range(1000)])
    names = [f"c{i}" for i in range(1000)]

    def nodes(columns):
        return analyze.correlation_pairs(wide, columns)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert nodes(names) == nodes(names[:3])
    got = analyze.correlation_pairs(wide, names)
    assert got.count() == 1000 * 999 // 2
    found = {(r["col1"], r["col2"]): r["correlation"] for r in got.filter("col1 IN ('c0', 'c70')").collect()}
    want = np.corrcoef(x.T)
    assert found["c0", "c999"] == -1.0
    assert all(v == pytest.approx(want[int(a[1:]), int(b[1:])], abs=6e-5) for (a, b), v in found.items())
