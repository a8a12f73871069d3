"""Every registered query of the subpackage against its SQL."""

import pytest

import __spark_entry__ as entry
from lendframe.llm import queries
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), entry.queries()[name], queries.SQL[name], sf_dir) == ""


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
