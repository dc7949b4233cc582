"""Two-valued predicates: a null operand makes a test false and never reaches a negation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def greater(a: Column, b: Column) -> Column:
    """On vectors: their first elements."""
    return sure(F.get(a, F.lit(0)) > F.get(b, F.lit(0)))


def less(a: Column, b: Column) -> Column:
    return greater(b, a)


def equal(*v: Column) -> Column:
    return reduce(lambda a, b: a & b, [sure(v[0] == x) for x in v[1:]], F.lit(True))


def identical(*v: Column) -> Column:
    """Syntactic identity: a missing value is identical with a missing one."""
    return reduce(lambda a, b: a & b, [v[0].eqNullSafe(x) for x in v[1:]], F.lit(True))


def exclusive(*v: Column) -> Column:
    """All pairwise different."""
    return reduce(lambda a, b: a & b, [sure(a != b) for a, b in combinations(v, 2)], F.lit(True))


def member(x: Column, items: Column) -> Column:
    return sure(F.array_contains(items, x))


def subset(a: Column, b: Column) -> Column:
    return sure(F.size(F.array_except(a, b)) == 0)


def both(*c: Column) -> Column:
    return reduce(lambda a, b: a & b, map(sure, c), F.lit(True))


def either(*c: Column) -> Column:
    return reduce(lambda a, b: a | b, map(sure, c), F.lit(False))


def neither(c: Column) -> Column:
    return ~sure(c)


def sequential_and(*steps: Column) -> Column:
    """True if all are, tried in order: what follows one that isn't true isn't evaluated."""
    out = F.lit(True)
    for x in reversed(steps):
        out = F.when(sure(x), out).otherwise(F.lit(False))
    return out


def sequential_or(*steps: Column) -> Column:
    """True if any is, tried in order: what follows a true one isn't evaluated."""
    out = F.lit(False)
    for x in reversed(steps):
        out = F.when(sure(x), F.lit(True)).otherwise(out)
    return out


def first_true(bools: Column) -> Column:
    return sure(F.get(bools, F.lit(0)))


def cond(*branches: tuple[Column, Column] | Column) -> Column:
    """(test, value) pairs and an optional default; without one, a false."""
    out, default = None, F.lit(False)
    for b in branches:
        if isinstance(b, tuple):
            out = F.when(sure(b[0]), b[1]) if out is None else out.when(sure(b[0]), b[1])
        else:
            default = b
    return default if out is None else out.otherwise(default)
