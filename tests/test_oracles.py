"""Every registered query with a SQL counterpart agrees with DuckDB."""

import os

import compare
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    assert compare.differences(df, con, contract.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 12


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
