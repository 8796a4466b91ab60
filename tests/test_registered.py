import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from corpuskit.plans import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_flagship(spark):
    rows = {r.split: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"train", "test"}


def test_every_query_has_sql():
    assert set(oracle.ORACLE) == set(catalog.QUERIES)
    assert set(oracle.ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_equals_sql(spark, con, name):
    problem, rows = compare(spark, con, name, catalog.QUERIES[name], oracle.ORACLE[name], SF)
    assert problem == "" and rows > 0
