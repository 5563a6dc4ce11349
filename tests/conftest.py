import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session("tests", 4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """The rows of a frame as sorted tuples."""
    return lambda frame, *columns: sorted((tuple(r[c] for c in (columns or frame.columns)) for r in frame.collect()), key=repr)
