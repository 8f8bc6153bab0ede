import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pictorium.session import local_session  # noqa: E402

DATA = os.environ.get("PICTORIUM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("test data not found")
    return DATA


@pytest.fixture()
def library(spark):
    def make(*texts):
        rows = [(i, f"p{i}.jpg", t, f"/photos/p{i}.jpg") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "photo_id long, filename string, description string, full_path string")

    return make


@pytest.fixture()
def queries(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")

    return make
