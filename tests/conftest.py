import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from paperloom.session import local_session

    os.environ.setdefault("BENCH_DRIVER_MEMORY", "8g")
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a frame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
