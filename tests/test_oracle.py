"""Every registered query of the core against its SQL, and the others for rows and schema."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import problems, reference

QUERIES = {**reference.queries(), **problems.queries()}
SQL = {**reference.ORACLE, **problems.ORACLE}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (np.integer, int)) and not isinstance(v, bool):
        return float(v)
    return float(v) + 0.0 if isinstance(v, (float, np.floating)) else v


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, small, name):
    ours = QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
