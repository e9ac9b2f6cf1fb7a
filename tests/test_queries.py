"""Every registered query of the reference's own operators, against its DuckDB form where it has one."""

import glob
import os

import duckdb
import pytest

from parley.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, list | tuple):
        return str([plain(x) for x in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLES:
        found = con.sql(registry.ORACLES[name])
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    else:
        assert rows
