import os

import pytest

from kelpline.session import local_session, ship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "4g")
    ship(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return DATA
