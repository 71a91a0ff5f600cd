import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import local_session  # noqa: E402

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("quire-tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"
