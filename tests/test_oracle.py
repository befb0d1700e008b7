from __future__ import annotations

import pytest
from check import connect, difference

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    rows = contract.queries()[name](spark, sf_dir).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
    else:
        assert difference(rows, con.execute(sql).df()) is None


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["doc_id", "lang", "translated", "n_chunks", "n_failed", "verdict"]
