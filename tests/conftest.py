import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from glyphline.session import local_session

    return local_session(8, "glyphline-tests")


@pytest.fixture(scope="session")
def duck():
    from glyphline.plans.check import connect

    return connect(SF)
