import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from paperloom.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session.sparkContext)
    yield session
    session.stop()
