"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

#: the corpus operators have tests of their own
QUERIES = entry.catalog.queries()
ORACLES = entry.catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["pca", "importance_table", "run_metadata_sink"])
def test_queries_without_sql_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
