from __future__ import annotations

import os

import pytest

from suite.data import DEMO_KEYS
from veladura.session import delete_scratch, local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    delete_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def keys():
    return DEMO_KEYS


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def texts(spark):
    """A frame ``(id, v)`` of the given texts."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "id bigint, v string")

    return make


@pytest.fixture
def apply(texts):
    """The results of a column function on the given texts, in order."""
    from pyspark.sql import functions as F

    def run(function, *values):
        rows = texts(*values).select("id", function(F.col("v")).alias("out")).orderBy("id")
        return [r.out for r in rows.collect()]

    return run
