import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def df_of(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
