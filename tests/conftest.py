import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from notespark.session import local_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_spark(4, "notespark-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]
