import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from voxhive.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8)
    yield session
    session.stop()


@pytest.fixture
def cells(spark):
    """Cell list (tuples of x, y, z[, more]) to a table."""
    def make(rows, *extra):
        names = ["x", "y", "z", *[e.split()[0] for e in extra]]
        schema = ", ".join(["x bigint", "y bigint", "z bigint", *extra])
        return spark.createDataFrame(pd.DataFrame(list(rows), columns=names), schema)
    return make


def triples(df):
    return {(r["x"], r["y"], r["z"]) for r in df.select("x", "y", "z").collect()}
