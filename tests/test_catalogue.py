"""Every registered query against its SQL on the smallest data set."""

import pytest

from stockloom.catalog import load
from tools.check import compare, connect

QUERIES = load()
MODELS = {"fct10_boosted_trees", "fct13_tuned_trees", "fct14_early_stopping"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_query_equals_sql(spark, duck, small, name):
    status, detail, _ = compare(QUERIES[name], spark, duck, small)
    assert status in ("ok", "noise"), detail


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None and n not in MODELS])
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    first = contract.entry(spark)
    assert first.count() > 0
    assert first.schema == contract.entry(spark).schema
