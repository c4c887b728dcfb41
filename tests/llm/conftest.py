import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from barloom.llm.common import workers_import

    workers_import(spark)
