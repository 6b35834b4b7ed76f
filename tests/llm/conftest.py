import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return brute.odd_docs(spark)


@pytest.fixture(scope="session")
def none(spark):
    return brute.no_docs(spark)
