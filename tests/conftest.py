import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rasterloom.session import local_session

    s = local_session("tests", cores="4", shuffle=4, driver_memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
