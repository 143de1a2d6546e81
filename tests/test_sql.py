"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from inkwell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert mine == theirs
