import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4")


@pytest.fixture
def files(spark):
    """Make a file table from {path: text} of one repository."""

    def make(mapping, repo="r"):
        rows = [(repo, p, p.rsplit(".", 1)[-1], t, False) for p, t in mapping.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, ext string, content string, changed boolean")

    return make
