import pytest

from labelforge.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
