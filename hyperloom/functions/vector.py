"""Vector-valued arithmetic on array columns, with each operator's own rule for unequal lengths.

Sums pad with 0 and products with 1; a vector of length 1 goes with every element. Powers,
minima, maxima and masks stop at the shorter one. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Binary = Callable[[Column, Column], Column]


def scalar(x: float | Column) -> Column:
    """A number as a vector of length 1."""
    return F.array((F.lit(float(x)) if isinstance(x, int | float) else x).cast("double"))


def _wise(a: Column, b: Column, f: Binary, pad: float | None) -> Column:
    if pad is None:
        n = F.least(F.size(a), F.size(b))
        both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f)
    else:
        both = F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(pad)), F.coalesce(y, F.lit(pad))))
    one = F.transform(b, lambda y: f(F.get(a, F.lit(0)), y))
    other = F.transform(a, lambda x: f(x, F.get(b, F.lit(0))))
    return F.when((F.size(a) == 1) & (F.size(b) != 1), one).when((F.size(b) == 1) & (F.size(a) != 1), other).otherwise(both)


def ieee_divide(x: Column, y: Column) -> Column:
    """Division as of doubles: by zero it gives an infinity or NaN instead of an error."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(y != 0, x / y).when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)


def plus(*v: Column) -> Column:
    return reduce(lambda a, b: _wise(a, b, lambda x, y: x + y, 0.0), v)


def minus(a: Column, b: Column | None = None) -> Column:
    return F.transform(a, lambda x: F.lit(0.0) - x) if b is None else _wise(a, b, lambda x, y: x - y, 0.0)


def times(*v: Column) -> Column:
    return reduce(lambda a, b: _wise(a, b, lambda x, y: x * y, 1.0), v)


def divide(a: Column, b: Column) -> Column:
    return _wise(a, b, ieee_divide, 1.0)


def power(a: Column, b: Column) -> Column:
    return _wise(a, b, F.pow, None)


def _shortest(v: tuple[Column, ...], f: Callable[..., Column]) -> Column:
    n = reduce(F.least, [F.size(x) for x in v]) if len(v) > 1 else F.size(v[0])
    return reduce(lambda a, b: F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f), v)


def maximum(*v: Column) -> Column:
    return _shortest(v, lambda x, y: F.greatest(x, y))


def minimum(*v: Column) -> Column:
    return _shortest(v, lambda x, y: F.least(x, y))


def unary(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.transform(v, lambda x: f(x).cast("double"))


floor, log2, sine, cosine, tangent, exp = (unary(f) for f in (F.floor, F.log2, F.sin, F.cos, F.tan, F.exp))


def heaviside(v: Column) -> Column:
    """1 less the sign bit: 1 from zero on, 0 below and for a negative zero."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x < 0, 0.0).when((x == 0) & x.cast("string").startswith("-"), 0.0).otherwise(1.0)

    return F.transform(v, one)


def size_of(*v: Column) -> Column:
    """Sum of the sizes of lists."""
    return reduce(lambda a, b: a + b, [F.size(x) for x in v]).cast("long")


def now() -> Column:
    """The present time in seconds."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def construct(kind: str, *parts: Column) -> Column:
    """A value of the named kind from its parts: numbers, texts or truths into one vector, or anything into a structure."""
    types = {"FloatValue": "double", "Float32Value": "float", "StringValue": "string", "BoolValue": "boolean"}
    if kind in types:
        return F.array(*[x.cast(types[kind]) for x in parts])
    if kind == "LinkValue":
        return F.struct(*[x.alias(f"_{i}") for i, x in enumerate(parts)])
    raise ValueError(f"{kind} can't be made of parts")


def random(low: Column, high: Column, seed: int = 0) -> Column:
    """Uniform in [low, high), element by element."""
    return _wise(low, high, lambda a, b: a + F.rand(seed) * (b - a), 0.0)


def impulse(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x, 1.0).otherwise(0.0))


def decimate(mask: Column, v: Column) -> Column:
    """Elements where the mask is true (a number: above 0), as far as both go."""
    n = F.least(F.size(mask), F.size(v))
    return F.filter(F.slice(v, 1, n), lambda x, i: F.get(mask, i).cast("double") > 0)


def elements(index: Column, v: Column) -> Column:
    """Elements by a list of indexes from 0, rounded half up; one out of range is an error."""
    return F.transform(index, lambda d: F.element_at(v, F.floor(d + 0.5).cast("int") + 1))


def accumulate(v: Column) -> Column:
    """Sum of a vector; of a bool vector, its trues."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def fold(v: Column, start: Column, f: Binary) -> Column:
    """Right fold."""
    return F.aggregate(F.reverse(v), start, f)


def dot(a: Column, b: Column) -> Column:
    return accumulate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def concatenate(lists: Column) -> Column:
    return F.flatten(lists)


def bool_and(*v: Column) -> Column:
    """Element-wise; as long as the longest, missing elements true."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(True)) & F.coalesce(y, F.lit(True))), v)


def bool_or(*v: Column) -> Column:
    """Element-wise; as long as the longest, missing elements false."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))), v)


def bool_not(v: Column) -> Column:
    return F.transform(v, lambda x: ~x)


def float32(v: Column) -> Column:
    """The vector in single precision."""
    return v.cast("array<float>")


def vector_sum(df, key: list[str], vector: str):
    """Element-wise sum over rows by key, shorter vectors padded with zeros: key and ``sum``."""
    each = df.select(*key, F.posexplode(vector).alias("pos", "x")).groupBy(*key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"))


def gather(df, key: list[str], order: list[str], value: str):
    """Float column: one number a row into a vector by key, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*key).agg(F.transform(rows, lambda s: s["_v"]).alias("column"))


def transpose(df, order: str, row: str, rows_a_part: int = 1 << 16):
    """Rows of vectors into columns of vectors: pos, part, column.

    A column is cut into parts by ``order`` (a number), so that no row grows with the table.
    """
    each = df.select(F.floor(F.col(order) / rows_a_part).alias("part"), order, F.posexplode(row).alias("pos", "x"))
    return each.groupBy("pos", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda s: s["x"]).alias("column"))
