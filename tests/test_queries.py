"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in SQLS])
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], SQLS[name], sf_dir) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_unique_and_every_sql_has_a_query():
    from lendframe.plans import oracle
    assert set(oracle.SQL) <= set(entry.queries())
