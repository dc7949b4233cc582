"""The open, nominal type lattice, and filters on it that are expanded when a plan is made.

``isa`` never joins: the set of subtypes is small and known to the planner, so it becomes
an ``IN`` filter that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The core of the lattice, child then parents. Others are declared at run time.
CORE = """
Value: TopType
Atom: Value
Node: Atom
Link: Atom
VoidValue: Value
BoolValue: Value
FloatValue: Value
Float32Value: Value
StringValue: Value
LinkValue: Value
SectionValue: LinkValue
StreamValue: LinkValue
FormulaStream: StreamValue
FutureStream: StreamValue
FlatStream: StreamValue
RandomStream: FloatValue
ContainerValue: LinkValue
QueueValue: ContainerValue
UnisetValue: ContainerValue
RelationalValue: UnisetValue
GroupValue: RelationalValue
SortedValue: RelationalValue
Concept: Node
Predicate: Node
Number: Node
Type: Node
TypeInh: Type
TypeCoInh: Type
Variable: Node
Glob: Node
Anchor: Node
Item: Node
OrderedLink: Link
UnorderedLink: Link
List: OrderedLink
Set: UnorderedLink
And: UnorderedLink
Or: UnorderedLink
Not: OrderedLink
Member: OrderedLink
Subset: OrderedLink
Inheritance: OrderedLink
Implication: OrderedLink
Similarity: UnorderedLink
Evaluation: OrderedLink
Edge: Evaluation
Execution: OrderedLink
State: OrderedLink
Grant: OrderedLink
Define: OrderedLink
Section: OrderedLink
"""


class Lattice:
    """Declared types and their parents; closed upward and downward on demand."""

    def __init__(self, text: str = CORE):
        self.parents: dict[str, set[str]] = {"TopType": set()}
        self.load(text)

    def load(self, text: str) -> Lattice:
        """Reads lines ``Child: Parent, Parent`` (or ``CHILD <- PARENT,PARENT``); ``#`` and ``//`` start comments."""
        for line in text.splitlines():
            line = line.split("#")[0].split("//")[0].strip()
            if line:
                child, _, rest = line.replace("<-", ":", 1).partition(":")
                self.declare(child.strip(), *[p.strip() for p in rest.split(",") if p.strip()])
        return self

    def declare(self, name: str, *parents: str) -> Lattice:
        for p in parents:
            self.parents.setdefault(p, {"TopType"} if p != "TopType" else set())
            if name in self.ancestors(p):
                raise ValueError(f"{name} would be its own ancestor")
        self.parents.setdefault(name, set()).update(parents or {"TopType"})
        return self

    def ancestors(self, name: str) -> set[str]:
        out, todo = {name}, [name]
        while todo:
            for p in self.parents.get(todo.pop(), ()):
                if p not in out:
                    out.add(p)
                    todo.append(p)
        return out

    def descendants(self, name: str) -> set[str]:
        return {x for x in self.parents if name in self.ancestors(x)} | {name}

    def is_a(self, name: str, ancestor: str) -> bool:
        return ancestor in self.ancestors(name)

    def unordered(self, name: str) -> bool:
        return self.is_a(name, "UnorderedLink")

    def table(self, spark: SparkSession) -> DataFrame:
        """type_isa(type, ancestor), the lattice's closure."""
        return spark.createDataFrame([(t, a) for t in sorted(self.parents) for a in sorted(self.ancestors(t))], "type string, ancestor string")


class TypeSpec:
    """A set of admitted types and an arity interval; combines by | and &."""

    def __init__(self, types: Iterable[str] | None, low: int = 1, high: int | None = 1):
        self.types = None if types is None else frozenset(types)
        self.low, self.high = max(0, low), None if high is None or high < 0 else high

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TypeSpec) and (self.types, self.low, self.high) == (other.types, other.low, other.high)

    def __hash__(self) -> int:
        return hash((self.types, self.low, self.high))

    @classmethod
    def exact(cls, name: str) -> TypeSpec:
        return cls([name])

    @classmethod
    def inherits(cls, lattice: Lattice, name: str) -> TypeSpec:
        return cls(lattice.descendants(name))

    @classmethod
    def coinherits(cls, lattice: Lattice, name: str) -> TypeSpec:
        return cls(lattice.ancestors(name))

    @classmethod
    def interval(cls, low: int, high: int) -> TypeSpec:
        """Arity bounds of a glob; a negative lower bound is 0, a negative upper one is none."""
        return cls(None, low, high)

    def __or__(self, other: TypeSpec) -> TypeSpec:
        """Union of types; the hull of the intervals."""
        types = None if self.types is None or other.types is None else self.types | other.types
        high = None if self.high is None or other.high is None else max(self.high, other.high)
        return TypeSpec(types, min(self.low, other.low), high)

    def __and__(self, other: TypeSpec) -> TypeSpec:
        types = other.types if self.types is None else self.types if other.types is None else self.types & other.types
        high = other.high if self.high is None else self.high if other.high is None else min(self.high, other.high)
        return TypeSpec(types, max(self.low, other.low), high)

    def admits(self, type_: Column) -> Column:
        return F.lit(True) if self.types is None else type_.isin(*sorted(self.types))

    def admits_size(self, size: Column) -> Column:
        ok = size >= self.low
        return ok if self.high is None else ok & (size <= self.high)


@dataclass(frozen=True)
class Signature:
    """A structural type: links of ``type`` whose children are admitted one by one by ``children`` (TypeSpecs or Signatures)."""

    type: str
    children: tuple

    def __init__(self, type: str, *children: TypeSpec | Signature):
        object.__setattr__(self, "type", type)
        object.__setattr__(self, "children", tuple(children))


class Arrow:
    """A function type: argument specs and a result spec."""

    def __init__(self, args: list[TypeSpec], result: TypeSpec):
        self.args, self.result = args, result

    def accepts(self, *types: str) -> bool:
        return len(types) == len(self.args) and all(s.types is None or t in s.types for s, t in zip(self.args, types, strict=True))

    def admits(self, *types: Column) -> Column:
        """``accepts`` over columns of type names."""
        if len(types) != len(self.args):
            return F.lit(False)
        return reduce(lambda a, b: a & b, [F.coalesce(s.admits(t), F.lit(False)) for s, t in zip(self.args, types, strict=True)], F.lit(True))

    def compose(self, after: Arrow) -> Arrow | None:
        """This function, then ``after`` on its result; None where the types don't meet."""
        if len(after.args) != 1:
            return None
        want = after.args[0].types
        fits = want is None or (self.result.types is not None and self.result.types <= want)
        return Arrow(self.args, after.result) if fits else None


def spark_type(name: str) -> T.DataType:
    """The column type that holds a value type."""
    known = {
        "VoidValue": T.NullType(),
        "BoolValue": T.ArrayType(T.BooleanType()),
        "FloatValue": T.ArrayType(T.DoubleType()),
        "RandomStream": T.ArrayType(T.DoubleType()),
        "Float32Value": T.ArrayType(T.FloatType()),
        "StringValue": T.ArrayType(T.StringType()),
    }
    return known.get(name, T.ArrayType(T.VariantType()))
