import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import awkward, empty  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return empty(spark)
