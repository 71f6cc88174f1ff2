import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import CLASHES, SCHEMA, odd_rows  # noqa: E402


@pytest.fixture
def documents(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def odd(documents):
    return documents(odd_rows())


@pytest.fixture
def clashing(odd):
    for name in CLASHES:
        odd = odd.withColumn(name, odd["lang"])
    return odd
