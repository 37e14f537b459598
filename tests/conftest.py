import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from wayloom.session import local_session

    return local_session(8, 2, "4g")
