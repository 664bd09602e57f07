import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("STUDYHALL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from studyhall.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app="studyhall-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from studyhall.plans.registry import tables as load

    return load(spark, SF_SMALL)


class FrameTables(dict):
    """Hand-made table mapping for unit tests (name -> DataFrame)."""

    n_customer = 100
    n_supplier = 10


@pytest.fixture
def frames():
    return FrameTables
