"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry_point
from factlake.plans.registry import QUERIES, Tables

from .compare import compare, connect
from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name].run(Tables(spark, SMALL))
    rows, faults = compare(QUERIES[name], df, duck)
    assert not faults, "\n".join(faults)
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 5
    assert "permalink" in df.columns


def test_contract():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())
