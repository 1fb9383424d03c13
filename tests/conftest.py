import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tickframe.session import get_session
    return get_session("local[*]", shuffle_partitions=8)


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
