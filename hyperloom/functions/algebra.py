"""Arithmetic terms: symbolic reduction of open ones, and columns for closed or bound ones.

A term over Plus, Minus, Times and numbers is a polynomial in its other subterms; reduction
collects equal monomials and writes the polynomial back in a canonical order, so two terms
that reduce alike are equal.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.terms import Glob, Link, Node, Var
from . import vector as v

Monomial = tuple  # sorted factors, each repeated by its power


def number(x: float) -> Node:
    return Node("Number", repr(float(x)))


def _by_number(t: Any) -> bool:
    """A quotient by a number other than 0."""
    return isinstance(t, Link) and t.type == "Divide" and len(t.out) == 2 and isinstance(t.out[1], Node) and t.out[1].type == "Number" and float(t.out[1].name) != 0


def _polynomial(t: Any) -> Counter:
    if isinstance(t, Node) and t.type == "Number":
        return Counter({(): float(t.name)})
    if isinstance(t, Link) and t.type == "Plus":
        total: Counter = Counter()
        for x in t.out:
            for m, c in _polynomial(x).items():
                total[m] += c
        return total
    if isinstance(t, Link) and t.type == "Minus":
        first, *rest = t.out if len(t.out) > 1 else (number(0), *t.out)
        total = Counter(_polynomial(first))
        for x in rest:
            for m, c in _polynomial(x).items():
                total[m] -= c
        return total
    if isinstance(t, Link) and t.type == "Times":
        total = Counter({(): 1.0})
        for x in t.out:
            p = _polynomial(x)
            new: Counter = Counter()
            for m, c in total.items():
                for n, d in p.items():
                    new[tuple(sorted([*m, *n], key=repr))] += c * d
            total = new
        return total
    if _by_number(t):
        return Counter({m: c / float(t.out[1].name) for m, c in _polynomial(t.out[0]).items()})
    if isinstance(t, Link):
        return Counter({(Link(t.type, *map(reduce_term, t.out)),): 1.0})
    return Counter({(t,): 1.0})


def reduce_term(t: Any) -> Any:
    """The term with like parts collected, constants folded and zeros gone."""
    if not isinstance(t, Link) or not (t.type in ("Plus", "Minus", "Times") or _by_number(t)):
        return Link(t.type, *map(reduce_term, t.out)) if isinstance(t, Link) else t
    parts = []
    for m, c in sorted(_polynomial(t).items(), key=lambda mc: (-len(mc[0]), repr(mc[0]))):
        if c == 0:
            continue
        factors = [*([number(c)] if c != 1 or not m else []), *m]
        parts.append(factors[0] if len(factors) == 1 else Link("Times", *factors))
    if not parts:
        return number(0)
    return parts[0] if len(parts) == 1 else Link("Plus", *parts)


FUNCTIONS = {
    "Plus": v.plus,
    "Minus": v.minus,
    "Times": v.times,
    "Divide": v.divide,
    "Pow": v.power,
    "Max": v.maximum,
    "Min": v.minimum,
    "Floor": v.floor,
    "Log2": v.log2,
    "Sine": v.sine,
    "Cosine": v.cosine,
    "Tan": v.tangent,
    "Exp": v.exp,
    "Heaviside": v.heaviside,
    "Impulse": v.impulse,
    "Decimate": v.decimate,
    "ElementOf": v.elements,
    "BoolAnd": v.bool_and,
    "BoolOr": v.bool_or,
    "BoolNot": v.bool_not,
    "Accumulate": lambda x: F.array(v.accumulate(x)),
    "Concatenate": lambda *x: v.concatenate(F.array(*x)),
}


def column(t: Any, bound: dict[str, Column] | None = None) -> Column:
    """A vector column for an arithmetic term; variables are taken from ``bound`` (vectors)."""
    if isinstance(t, Var | Glob):
        if not bound or t.name not in bound:
            raise ValueError(f"{t.name} isn't bound")
        return bound[t.name]
    if isinstance(t, Node):
        return F.array(*[F.lit(float(x)) for x in t.name.split()])
    if t.type not in FUNCTIONS:
        raise ValueError(f"{t.type} isn't a function")
    return FUNCTIONS[t.type](*[column(x, bound) for x in t.out])


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


TESTS = {
    "GreaterThan": lambda a, b: _first(a) > _first(b),
    "LessThan": lambda a, b: _first(a) < _first(b),
    "Equal": lambda a, b: a == b,
}


def truth(t: Any, bound: dict[str, Column]) -> Column:
    """A boolean column for a test: comparisons of arithmetic terms under And, Or and Not. Variables are numbers."""
    vectors = {k: F.array(c.cast("double")) for k, c in bound.items()}

    def go(x: Any) -> Column:
        if isinstance(x, Link) and x.type in ("And", "Or"):
            parts = [go(y) for y in x.out]
            return reduce((lambda a, b: a & b) if x.type == "And" else (lambda a, b: a | b), parts)
        if isinstance(x, Link) and x.type == "Not":
            return ~go(x.out[0])
        if isinstance(x, Link) and x.type in TESTS:
            return F.coalesce(TESTS[x.type](*[column(y, vectors) for y in x.out]), F.lit(False))
        raise ValueError(f"{x} isn't a test")

    return go(t)
