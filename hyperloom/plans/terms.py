"""Query terms and clauses: immutable descriptions that the planner turns into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from .types import Signature, TypeSpec


@dataclass(frozen=True)
class Var:
    """Binds one atom."""

    name: str
    spec: TypeSpec | Signature | None = None


@dataclass(frozen=True)
class Glob:
    """Binds a sequence of atoms: one or more unless its spec says otherwise."""

    name: str
    spec: TypeSpec | None = None

    @property
    def bounds(self) -> tuple[int, int | None]:
        return (1, None) if self.spec is None else (self.spec.low, self.spec.high)


@dataclass(frozen=True)
class Node:
    type: str
    name: str


@dataclass(frozen=True)
class Quoted:
    """A variable of the data, matched as it stands."""

    term: Any


@dataclass(frozen=True)
class Sign:
    """Stands for any atom of a type and binds nothing."""

    spec: TypeSpec | Signature


@dataclass(frozen=True)
class Link:
    type: str
    out: tuple

    def __init__(self, type: str, *out: Any):
        object.__setattr__(self, "type", type)
        object.__setattr__(self, "out", tuple(out))


Term = Var | Glob | Node | Link | Quoted | Sign


def variables(term: Any) -> list[str]:
    if isinstance(term, Var | Glob):
        return [term.name]
    if isinstance(term, Link):
        return list(dict.fromkeys(v for t in term.out for v in variables(t)))
    return []


def is_closed(term: Any) -> bool:
    return not variables(term)


def substitute(term: Any, by: dict[str, Any]) -> Any:
    """Replaces variables; quoted ones stay, and a glob's value, a tuple, is spliced in."""
    if isinstance(term, Var | Glob):
        return by.get(term.name, term)
    if isinstance(term, Link):
        out: list[Any] = []
        for t in term.out:
            x = substitute(t, by)
            out += list(x) if isinstance(t, Glob) and isinstance(x, tuple) else [x]
        return Link(term.type, *out)
    return term


def canonical(term: Any, bound: Sequence[str] | None = None) -> Any:
    """The term with its variables numbered in order of appearance: equal for alpha-equal terms."""
    names = {v: f"${i}" for i, v in enumerate(variables(term)) if bound is None or v in bound}

    def go(t: Any) -> Any:
        if isinstance(t, Var | Glob):
            return type(t)(names.get(t.name, t.name), t.spec)
        return Link(t.type, *map(go, t.out)) if isinstance(t, Link) else t

    return go(term)


def alpha_equal(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


@dataclass(frozen=True)
class Lambda:
    """A function of terms."""

    params: tuple[str, ...]
    body: Any

    def __call__(self, *args: Any) -> Any:
        if len(args) != len(self.params):
            raise TypeError("wrong number of arguments")
        return substitute(self.body, dict(zip(self.params, args, strict=True)))

    def alpha(self, *names: str) -> Lambda:
        """The same function with other parameter names."""
        return Lambda(names, substitute(self.body, {p: Var(n) for p, n in zip(self.params, names, strict=True)}))


@dataclass(frozen=True)
class Rule:
    """Variables, a premise, and what follows from it."""

    vars: tuple[str, ...]
    premise: Any
    conclusions: tuple

    def applied(self, binding: dict[str, Any]) -> tuple:
        return tuple(substitute(c, binding) for c in self.conclusions)


def prenex(op: str, *lambdas: Lambda) -> Lambda:
    """Joins lambdas under ``op`` with all parameters in front, renaming those that clash."""
    params: list[str] = []
    bodies = []
    for f in lambdas:
        new = []
        for p in f.params:
            n, i = p, 1
            while n in params or n in new:
                n, i = f"{p}_{i}", i + 1
            new.append(n)
        bodies.append(f.alpha(*new).body)
        params += new
    return Lambda(tuple(params), Link(op, *bodies))


# ---- clauses ------------------------------------------------------------------------------


@dataclass(frozen=True, eq=False)
class Table:
    """A clause on a wide table: variables name columns or expressions of it; ``where`` filters it."""

    df: DataFrame
    binds: dict[str, str | Column]
    where: Column | str | None = None

    def __hash__(self) -> int:
        return id(self)


@dataclass(frozen=True)
class Match:
    """A clause on the atom table: some stored atom has this shape. ``as_`` binds the atom itself."""

    term: Link | Node
    as_: str | None = None


@dataclass(frozen=True)
class Present:
    clauses: tuple

    def __init__(self, *clauses: Any):
        object.__setattr__(self, "clauses", tuple(dict.fromkeys(clauses)))


@dataclass(frozen=True)
class Absent:
    """No match of the clause for the grounding."""

    clause: Any


@dataclass(frozen=True)
class Always:
    """In each group of equal ``by``, every match of ``over`` satisfies ``holds``; groups without a match pass.

    With ``same``, all matches of a group have one value of it.
    """

    over: Any
    by: tuple[str, ...]
    holds: Callable[[Callable[[str], Column]], Column] | None = None
    same: str | None = None


@dataclass(frozen=True)
class Choice:
    """Any of the alternatives."""

    branches: tuple

    def __init__(self, *branches: Any):
        object.__setattr__(self, "branches", tuple(branches))


class Or(Choice):
    """Patterns that are grounded each by itself, with absences and tests of their own; a variable that one lacks stays null."""


@dataclass(frozen=True)
class And:
    clauses: tuple

    def __init__(self, *clauses: Any):
        object.__setattr__(self, "clauses", tuple(clauses))


@dataclass(frozen=True)
class Not:
    clause: Any


@dataclass(frozen=True)
class Exists:
    """Some match of the clause for the grounding; it binds nothing."""

    clause: Any


@dataclass(frozen=True, eq=False)
class Where:
    """An evaluatable clause: a boolean of variables. Two are equal only if they are one object, as functions can't be compared.

    ``many``: the join whose pairs it tests shares few values and leaves many pairs of each, so
    they are dealt out evenly and not by those values alone.
    """

    vars: tuple[str, ...]
    test: Callable[..., Column]
    many: bool = False


@dataclass(frozen=True, eq=False)
class Bind:
    """Gives a variable the value of an expression of others."""

    var: str
    vars: tuple[str, ...]
    value: Callable[..., Column]


@dataclass(frozen=True)
class Identical:
    """Two variables have one value; whichever is unbound takes the other's."""

    left: str
    right: str


@dataclass(frozen=True)
class Evaluation:
    """A predicate applied to variables: a Lambda whose body is a test, the name of a defined one, or a function of columns."""

    predicate: Any
    vars: tuple[str, ...]


def where(*vars_: str) -> Callable[[Callable[..., Column]], Where]:
    return lambda test: Where(tuple(vars_), test)


@dataclass
class Pattern:
    """A reusable named pattern: clauses with parameters."""

    params: tuple[str, ...]
    body: Any
