import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.fixtures import Inputs  # noqa: E402
from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Inputs(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def middle(spark):
    return Inputs(spark, "/root/testdata/sf0.01")
