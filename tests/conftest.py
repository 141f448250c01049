import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("PANELSPARK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import build_session

    return build_session("panelspark-tests", os.environ.get("PANELSPARK_TEST_CORES", "4"), spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf():
    return SF
