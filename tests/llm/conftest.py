from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """A table from column names and rows, in a few partitions."""

    def make(schema: str, rows: list[tuple], parts: int = 3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
