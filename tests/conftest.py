import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartlight.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def tables(spark):
    from cartlight.plans import catalogue
    from cartlight.plans.registry import Tables

    catalogue.load()
    return Tables(spark, SF)
