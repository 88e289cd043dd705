"""Tables with what real ones may hold: nulls in any column, empty, blank and
very long texts, ties, repeated rows, and extra columns named like the
operators' own."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from odd_rows import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf001):
    return spark.read.parquet(f"{sf001}/labels.parquet")
