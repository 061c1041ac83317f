import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanmask.session import local_session
    s = local_session("*", shuffle_partitions=8, app="spanmask-tests")
    yield s
    s.stop()


SPAN_SCHEMA = ("doc_id long, file string, label string, text string, start int, end int, score double, "
               "will_redact boolean, code string, source string")


@pytest.fixture
def spans_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, SPAN_SCHEMA)
    return make


@pytest.fixture
def docs_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, file string, text string")
    return make
