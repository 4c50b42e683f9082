"""Every registered query against its SQL, on the smallest tables."""

import pytest

from pairframe.plans import load_queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
CATALOG = load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(CATALOG.QUERIES[name](spark, SF_DIR), con, CATALOG.SQL[name]) is None


def test_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).columns == ["id", "cell_id", "drug_id", "label"]
    assert set(CATALOG.SQL) == set(CATALOG.QUERIES)
    assert set(CATALOG.QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())
