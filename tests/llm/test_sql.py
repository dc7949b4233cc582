"""The queries that SQL can express, against it."""

import glob
import os

import duckdb
import pytest

from hyperloom.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, name, sf_dir=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    assert names == sorted(c[0] for c in cursor.description)
    where = [[c[0] for c in cursor.description].index(n) for n in names]
    want = sorted(tuple(r[i] for i in where) for r in cursor.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert got == want
