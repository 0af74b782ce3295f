import glob
import os

import duckdb
import pytest

from tidemark.llm import queries as lq


@pytest.mark.parametrize("name", sorted(lq.ORACLE))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ours = lq.queries()[name](spark, small).toPandas()
    theirs = con.execute(lq.ORACLE[name]).fetchdf()[list(ours.columns)]
    assert sorted(map(tuple, ours.values.tolist()), key=repr) == sorted(map(tuple, theirs.values.tolist()), key=repr)


def test_every_query_runs(spark, small):
    for name, q in lq.queries().items():
        assert q(spark, small).columns, name
