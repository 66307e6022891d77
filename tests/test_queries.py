"""Every registered query against its SQL check on the given tables."""

import os

import pytest

import __spark_entry__ as contract
import compare
from tabwright.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
contract.queries()  # loads them
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_check_has_its_query():
    assert set(SQL) <= set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    found = compare.spark_result(QUERIES[name](spark, FOLDER))
    assert compare.differences(found, compare.sql_result(con, SQL[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    assert df.limit(1).count() == 1


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["r_name", "revenue"] and df.count() == 5
