import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from spanloom.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
