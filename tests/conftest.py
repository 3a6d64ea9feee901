import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build_session

    session = build_session("local[4]", 4, "3g")
    yield session
    session.stop()
