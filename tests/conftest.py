import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import session

    return session(8, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
