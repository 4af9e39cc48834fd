import pytest

from tests.compare import duck, session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)
