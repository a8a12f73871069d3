from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A small table from rows and a schema, over three partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)
    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
