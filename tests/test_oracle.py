"""Every query with SQL must equal DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
from catalogspark.plans import ORACLES, QUERIES
from catalogspark.plans.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    df = contract.queries()[name](spark, sf)
    assert differences(df.columns, df.collect(), con, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
