"""Every named query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from hyperloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int | float):
        return "nan" if math.isnan(x) else f"{float(x):.6g}"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())


def test_delimited_table(spark, tmp_path):
    from hyperloom.sources import text

    (tmp_path / "t.csv").write_text("# a comment\nb1, flt1, lbl\nT, 1.5, one\n\n0, -2, two\n# more\n1, x, three\n")
    got = {tuple(r) for r in text.delimited(spark, str(tmp_path / "t.csv"), "b1 boolean, flt1 double, lbl string").collect()}
    assert got == {(True, 1.5, "one"), (False, -2.0, "two"), (True, None, "three")}


def test_spanning_tree(spark):
    from hyperloom.operators.rewrite import spanning_tree

    edges = [(1, 2, 5), (2, 3, 9), (1, 3, 7), (4, 5, 1), (3, 4, 2), (6, 7, 3), (1, 1, 99)]
    tree = spanning_tree(spark.createDataFrame(edges, "a long, b long, w long"))
    assert {tuple(r) for r in tree.collect()} == {(2, 3, 9), (1, 3, 7), (3, 4, 2), (4, 5, 1), (6, 7, 3)}
    chain = [(i, i + 1, 1) for i in range(70)]
    assert spanning_tree(spark.createDataFrame(chain, "a long, b long, w long")).count() == 70


def agree(spark, name, folder, **tables):
    """A query against its SQL on tables of one's own; rows are compared as bags."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cursor = con.execute(catalog.ORACLE_SQL[name])
    got = rows(df.columns, df.collect())
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())
    return got


def test_heaviside_of_stored_zeros(spark, tmp_path):
    balances = [0.0, -0.0, -1e-300, 1e-300, None, math.nan, math.inf, -math.inf]
    agree(spark, "f6_heaviside", tmp_path, customer=spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double"))


def test_user_aggregate_by_batches(spark, tmp_path, monkeypatch):
    """Null keys, keys beyond a double's precision, nulls and NaN among prices, groups over many batches; calls grow with batches and not with groups."""
    from hyperloom.functions import udf

    keys = [None, 1, 2**60, 2**60 + 1, 5, 6]
    some = [(keys[i % 4], float(i * 37 % 101)) for i in range(400)] + [(5, None), (6, math.nan), (6, 1.0), (1, None), (7, None), (7, 3.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = agree(spark, "x4_aggregate", tmp_path, orders=spark.createDataFrame(some, "o_custkey long, o_totalprice double"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 7
    plans = []
    real = udf.aggregate
    monkeypatch.setattr(udf, "aggregate", lambda *a: plans.append(real(*a)) or plans[-1])
    catalog.QUERIES["x4_aggregate"](spark, str(tmp_path))
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_greater_pairs_are_dealt_out(spark, tmp_path):
    """One nation and repeated, null and tied rows: pairs as the SQL has them, in several tasks, with nothing above the join that holds them."""
    some = [(i // 2 if i % 9 else None, 3 if i % 7 else None, float(i % 23) if i % 5 else None) for i in range(200)] * 2
    agree(spark, "b1_j2_greater", tmp_path, supplier=spark.createDataFrame(some, "s_suppkey long, s_nationkey int, s_acctbal double"))
    df = catalog.QUERIES["b1_j2_greater"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "RepartitionByExpression" in plan
    from pyspark.sql import functions as F

    assert df.groupBy(F.spark_partition_id()).count().count() > 4
