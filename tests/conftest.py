import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "colweave-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Raw files from (name, content) pairs, or (request, side, name, content)."""

    def make(*rows):
        full = [r if len(r) == 4 else ("0", "source", *r) for r in rows]
        data = [(r, s, i, n, c) for i, (r, s, n, c) in enumerate(full)]
        return spark.createDataFrame(data, "request_id string, side string, pos bigint, file_name string, content string")

    return make
