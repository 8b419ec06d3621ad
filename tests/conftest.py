import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("GRAPHLOOM_DRIVER_MEMORY", "3g")
    from graphloom.session import session

    return session("tests", int(os.environ.get("TEST_CPUS", "2")))
