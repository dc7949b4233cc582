"""An object interface to a space: add, look up, attach values, run terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import algebra
from .plans import planner
from .plans.space import VALUES, Space, node_id
from .plans.terms import Link, Node, Var, is_closed
from .plans.types import Lattice
from .sources.text import rows_of


@dataclass(frozen=True)
class Atom:
    """A handle on a term in a graph."""

    graph: Graph
    term: Node | Link

    @property
    def type(self) -> str:
        return self.term.type

    @property
    def name(self) -> str | None:
        return self.term.name if isinstance(self.term, Node) else None

    @property
    def out(self) -> list[Atom]:
        return [Atom(self.graph, x) for x in self.term.out] if isinstance(self.term, Link) else []

    @property
    def arity(self) -> int:
        return len(self.out)

    def incoming(self, type_: str | None = None) -> DataFrame:
        space = self.graph.space
        return space.incoming(self.graph.ids(self.term), type_).drop("child_id")

    def get_value(self, key: str) -> list[Any] | None:
        rows = self.graph.space.value_of(self.graph.ids(self.term), key).limit(1).collect()
        return None if not rows else next((x for x in (rows[0]["fval"], rows[0]["sval"], rows[0]["bval"]) if x is not None), None)

    def set_value(self, key: str, value: Sequence[float | str | bool]) -> Atom:
        self.graph.set_value(self, key, value)
        return self

    def get_keys(self) -> list[str]:
        return sorted(r["key"] for r in self.graph.space.keys_of(self.graph.ids(self.term)).collect())

    def is_executable(self) -> bool:
        return isinstance(self.term, Link) and self.term.type in algebra.FUNCTIONS

    def execute(self) -> list[float]:
        return self.graph.execute(self.term)


class Graph:
    """A space that changes: additions are gathered and become part of it when it is read."""

    def __init__(self, spark: SparkSession, lattice: Lattice | None = None, parent: Graph | None = None):
        self.spark = spark
        self._space = Space.empty(spark, lattice) if parent is None else Space(parent.space.atoms, parent.space.values, parent.space.lattice)
        self._new: list[Node | Link] = []
        self._values: list[tuple] = []
        self.read_only = False

    @property
    def space(self) -> Space:
        if self._new:
            self._space = self._space.insert(rows_of(self._space, self._new))
            self._new = []
        if self._values:
            rows = None
            for term, key, kind, fval, sval, bval in self._values:
                one = self.spark.createDataFrame([(0, key, kind, fval, sval, bval)], VALUES).withColumn("atom_id", self.id_of(term))
                rows = one if rows is None else rows.unionByName(one)
            self._values = []
            self._space = self._space.set_values(rows)
        return self._space

    def id_of(self, term: Node | Link) -> Column:
        if isinstance(term, Link):
            ids = F.array(*map(self.id_of, term.out))
            return F.xxhash64(F.lit(term.type), F.array_sort(ids) if self._space.lattice.unordered(term.type) else ids)
        kind = "Variable" if isinstance(term, Var) else term.type
        return node_id(F.lit(kind), F.lit(term.name))

    def ids(self, term: Node | Link) -> DataFrame:
        return self.spark.range(1).select(self.id_of(term).alias("atom_id"))

    def add(self, term: Node | Link) -> Atom:
        if not self.read_only:
            self._new.append(term)
        return Atom(self, term)

    def add_node(self, type_: str, name: str) -> Atom:
        return self.add(Node(type_, name))

    def add_link(self, type_: str, *out: Atom | Node | Link) -> Atom:
        return self.add(Link(type_, *[x.term if isinstance(x, Atom) else x for x in out]))

    def set_value(self, atom: Atom, key: str, value: Sequence[float | str | bool]) -> None:
        if self.read_only:
            raise PermissionError("the graph is read-only")
        x = list(value)
        if x and all(isinstance(y, bool) for y in x):
            row = ("BoolValue", None, None, x)
        elif x and all(isinstance(y, str) for y in x):
            row = ("StringValue", None, x, None)
        else:
            row = ("FloatValue", [float(y) for y in x], None, None)
        self._values = [v for v in self._values if v[:2] != (atom.term, key)] + [(atom.term, key, *row)]

    def remove(self, atom: Atom, recursive: bool = False) -> bool:
        """Whether it went: an atom that a link holds stays, unless what holds it goes too."""
        self._space = self.space.extract(self.ids(atom.term), recursive)
        return not self.contains(atom.term)

    def clear(self) -> None:
        self._space, self._new, self._values = Space.empty(self.spark, self._space.lattice), [], []

    def contains(self, term: Node | Link) -> bool:
        return not self.space.atoms.join(self.ids(term), "atom_id", "left_semi").isEmpty()

    def size(self) -> int:
        return self.space.atoms.count()

    def atoms_by_type(self, type_: str, subtypes: bool = True) -> DataFrame:
        return self.space.by_type(type_, subtypes)

    def child(self) -> Graph:
        """A layer on top: what it changes isn't seen here."""
        return Graph(self.spark, parent=self)

    def execute(self, term: Node | Link) -> list[float]:
        """The value of a closed arithmetic term."""
        if not is_closed(term):
            raise ValueError("the term has free variables")
        return self.spark.range(1).select(algebra.column(term).alias("x")).first()["x"]

    def meet(self, vars_: Sequence[str], body: Any, **options: Any) -> DataFrame:
        return planner.meet(vars_, body, self.space, **options)
