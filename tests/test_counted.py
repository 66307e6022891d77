"""Profiles read off value counts that are written once."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tabwright.operators import columns as C, counted, profile


def _mixed(spark, rows=3000):
    rng = random.Random(5)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, None]
    start = dt.datetime(1969, 12, 1)
    data = [
        (
            rng.choice([i, i, None]), rng.choice([rng.gauss(0, 1e6), *odd]), rng.choice([1.5, 2.5, 2.5]), 2**53 + rng.randrange(40),
            start + dt.timedelta(minutes=977 * i, microseconds=i % 3), start.date() + dt.timedelta(days=min(rng.randrange(60), rng.randrange(60))),
            f"name {rng.randrange(3000):05d}", rng.choice(["é", "z", "", None]), rng.random() < 0.5, None,
        )
        for i in range(rows)
    ]
    return spark.createDataFrame(
        data, "id bigint, wide double, few double, big bigint, at timestamp, day date, name string, mark string, flag boolean, none double"
    )


def _plain(df, columns):
    """The same from value counts sorted whole."""
    counts = C.value_counts(df, columns)
    listed = lambda rows, *fields: {
        c: [tuple(r[f] for f in fields) for r in sorted(rows, key=lambda r: r["rank"]) if r["attribute"] == c] for c in columns
    }
    distinct = {r[0]: r[1] for r in C.distinct_counts(counts).collect()}
    first = listed(C.smallest_values(counts, 20).collect(), "value")
    return distinct, first, listed(C.top_values(counts, 5).collect(), "value", "n")


def _agree(spark, df):
    columns = C.flat_columns(df)
    distinct, ranked = counted.facts(df, columns, 20, 5, [0.25, 0.5, 0.75])
    got = {r["attribute"]: r for r in ranked.collect()}
    want = _plain(df, columns)
    numbers = C.numeric_columns(df)
    summary = {r["attribute"]: r for r in profile.numeric_summary(df, numbers).collect()}
    for c, n in zip(columns, distinct):
        assert n == want[0].get(c, 0)
        if not n:
            assert c not in got
            continue
        assert [(x["value"],) for x in got[c]["first"]] == want[1][c]
        if c in numbers:
            assert got[c]["quantiles"] == [summary[c][q] for q in ("p25", "median", "p75")]
        else:
            assert [(x["value"], x["n"]) for x in got[c]["most"]] == want[2][c]
            assert got[c]["quantiles"] is None


def test_facts_agree_with_counts_sorted_whole(spark):
    _agree(spark, _mixed(spark))
    _agree(spark, _mixed(spark, 7))


def test_quartiles_whose_brackets_fail_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(counted, "MARGIN", -0.1)
    _agree(spark, _mixed(spark))


def test_a_profile_ranks_few_of_many_values(spark):
    """F7, F8: all different values were sorted, for samples, top values and quartiles."""
    many = spark.range(200_000).selectExpr(
        "id", "id * 0.5D AS half", "timestamp'2020-01-01' + make_dt_interval(0, 0, id) AS at", "date'2020-01-01' + int(id % 900) AS day"
    )
    found = profile.profile_table(many)
    assert spark.read.parquet(*found.inputFiles()).count() < 30_000
    rows = {r["attribute"]: r for r in found.collect()}
    assert rows["half"]["median"] == pytest.approx(np.median(np.arange(200_000) * 0.5)) and rows["id"]["distinct_count"] == 200_000
    assert rows["at"]["sample_values"][1] == "2020-01-01 00:01:00"
    assert [tuple(x) for x in rows["day"]["top_5"]] == [(f"2020-01-0{i}", 223) for i in range(1, 6)]
    assert math.isclose(rows["id"]["p75"], 0.75 * 199_999)


def test_years_of_other_than_four_digits_are_ordered_as_texts(spark):
    df = spark.range(400).selectExpr("date_add(DATE'9999-12-01', int(id)) AS d", "id")
    _agree(spark, df)
