"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from sqlgauge.querybook import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    sql = catalog.ORACLES.get(name)
    assert sql is not None, "every registered query has its SQL"
    diff, _ = differences(spark, con, catalog.QUERIES[name], sql, SF)
    assert diff == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
