"""Every query with SQL against DuckDB on the same files; the others must run."""

import glob
import math
import os

import duckdb
import pytest

from linkstrata.queries.catalogue import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))  # tells -0.0 from 0.0, as a hash does
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(round(float(v), 9)) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted(([plain(x[names.index(c)]) for c in cols] for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
