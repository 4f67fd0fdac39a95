import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from seqloom.runtime import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-tests-"))
    yield s
    s.stop()


@pytest.fixture()
def rows():
    """A function that gives a frame's rows as a sorted list of tuples."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
