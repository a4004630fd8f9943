import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
    from runloom.session import local_session

    s = local_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
