"""Padding rules of vector operators, by property."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.functions import vector as v

VEC = st.lists(st.floats(-100, 100).map(lambda x: round(x, 3)), min_size=1, max_size=5)


def padded(a, b, f, pad):
    if len(a) == 1 and len(b) != 1:
        return [f(a[0], y) for y in b]
    if len(b) == 1 and len(a) != 1:
        return [f(x, b[0]) for x in a]
    n = min(len(a), len(b)) if pad is None else max(len(a), len(b))
    return [f(a[i] if i < len(a) else pad, b[i] if i < len(b) else pad) for i in range(n)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(VEC, VEC), min_size=20, max_size=20))
def test_padding(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = {r["i"]: r for r in df.select("i", v.plus(F.col("a"), F.col("b")).alias("p"), v.minus(F.col("a"), F.col("b")).alias("m"), v.times(F.col("a"), F.col("b")).alias("t"), v.maximum(F.col("a"), F.col("b")).alias("x")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i]["p"] == pytest.approx(padded(a, b, lambda x, y: x + y, 0))
        assert got[i]["m"] == pytest.approx(padded(a, b, lambda x, y: x - y, 0))
        assert got[i]["t"] == pytest.approx(padded(a, b, lambda x, y: x * y, 1))
        assert got[i]["x"] == [max(x, y) for x, y in zip(a, b, strict=False)]


def test_division(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, 6.0], [0.0, 0.0, 0.0, 3.0])], "a array<double>, b array<double>")
    q = df.select(v.divide(F.col("a"), F.col("b")).alias("q")).first()["q"]
    assert q[0] == float("inf") and q[1] == float("-inf") and q[2] != q[2] and q[3] == 2


def test_elements_out_of_range(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "a array<double>")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(v.elements(F.array(F.lit(7.0)), F.col("a"))).collect()
