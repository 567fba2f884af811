import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import duck  # noqa: E402
from riskspark.plans.lake import Lake  # noqa: E402
from riskspark.session import local_session  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    return Lake.of(spark, FOLDER)


@pytest.fixture(scope="session")
def database():
    return duck(FOLDER)
