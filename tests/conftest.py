import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def rows(spark):
    """Make a DataFrame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture()
def log(spark):
    """A one-project log with the given seconds; events are a, b, c … in turn."""

    def make(seconds, labels=None, project="p"):
        labels = labels or [0] * len(seconds)
        data = [
            (project, i + 1, int(t), int(t) * 1_000_000, "abcdefgh"[i % 8], l)
            for i, (t, l) in enumerate(zip(seconds, labels))
        ]
        return spark.createDataFrame(data, "project string, line long, t long, ts_us long, event string, label int")

    return make
