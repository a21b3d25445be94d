import os

import pytest

from quern.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples): a small DataFrame."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
