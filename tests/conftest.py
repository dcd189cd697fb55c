import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gavelflow.session import local_session  # noqa: E402


# columns can only be built while a session exists, and test modules build some at import
SESSION = local_session("8", shuffle_partitions=4, app="gavelflow-tests")
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def value(spark):
    """Evaluates one column expression."""
    return lambda col: spark.range(1).select(col.alias("v")).first()["v"]
