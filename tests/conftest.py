import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from barloom.session import local_session, release_scratch


@pytest.fixture(scope="session")
def spark():
    session = local_session("barloom-tests", "8", 4)
    yield session
    release_scratch(session)
    session.stop()
