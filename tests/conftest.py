import pytest

from quillon.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
