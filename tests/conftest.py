import pytest

from threadloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", driver_memory="8g")
    yield session
    session.stop()
