import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shipwise.session import local_session
    s = local_session(4, 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star(spark):
    from shipwise.sources.star import star_tables
    return star_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    from shipwise.oracle.compare import duck_connect
    return duck_connect(SF_SMALL)
