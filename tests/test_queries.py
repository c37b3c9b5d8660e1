"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from voxhive.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return repr(float(v) + 0.0)
    return int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else str(v)


def bag(pdf):
    return sorted((tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = con.execute(sql).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert bag(got) == bag(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
