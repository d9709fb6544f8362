import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import DOC_SCHEMA, LABEL_SCHEMA, edge_rows, prose_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def prose(spark):
    return spark.createDataFrame(prose_rows(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABEL_SCHEMA)
