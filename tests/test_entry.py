"""Every query that has SQL, held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def rows(columns, data):
    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, (float, int)) and not isinstance(v, bool) else v

    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(repr(plain(r[k])) for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = db.sql(SQL[name])
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
