"""Text sources: delimited tables, facts and clauses, s-expressions, JSON; and export."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import terms as t
from ..plans.space import Space, links, node_id, nodes


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header; blank lines and ``#`` lines are skipped, and T/F or 1/0 are booleans."""
    fields = T.StructType.fromDDL(schema)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    df = spark.read.csv(path, schema=raw, header=True, sep=sep, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    out = []
    for f in fields:
        c = F.col(f.name)
        if f.dataType == T.BooleanType():
            c = F.when(F.upper(c).isin("T", "1", "TRUE"), True).when(F.upper(c).isin("F", "0", "FALSE"), False)
        else:
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def columns_as_vectors(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column of a table as one vector by key, in row order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    out = df.groupBy(*key).agg(rows.alias("_r"))
    return out.select(*key, *[F.col("_r")[c].alias(c) for c in columns])


# ---- facts and clauses ---------------------------------------------------------------------

_TOKEN = re.compile(r"\s+|%[^\n]*|(?P<mark>:-|\?-|[().,])|\"(?P<text>(?:[^\"\\]|\\.)*)\"|(?P<word>[^\s().,:\"%]+)")


@dataclass
class Program:
    facts: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    rules: list[tuple[tuple[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]] = field(default_factory=list)


def parse_clauses(text: str) -> Program:
    """``likes(john, mary).`` and ``child(X, Y) :- parent(Y, X), person(X).``; capitals start variables."""
    marks = [m[m.lastgroup] if m.lastgroup != "text" else m["text"] for m in _TOKEN.finditer(text) if m.lastgroup]
    out, i = Program(), 0

    def atom() -> tuple[str, tuple[str, ...]]:
        nonlocal i
        name, i = marks[i], i + 1
        args = []
        if i < len(marks) and marks[i] == "(":
            i += 1
            while marks[i] != ")":
                if marks[i] != ",":
                    args.append(marks[i])
                i += 1
            i += 1
        return name, tuple(args)

    while i < len(marks):
        head, body = atom(), []
        if i < len(marks) and marks[i] == ":-":
            i += 1
            body.append(atom())
            while marks[i] == ",":
                i += 1
                body.append(atom())
        if i >= len(marks) or marks[i] != ".":
            raise ValueError(f"a clause for {head[0]} doesn't end")
        i += 1
        if body:
            out.rules.append((head, body))
        else:
            out.facts.setdefault(head[0], []).append(head[1])
    return out


def _is_variable(x: str) -> bool:
    return x[:1].isupper() or x[:1] == "_"


def evaluate(spark: SparkSession, program: Program, rounds: int = 100) -> dict[str, DataFrame]:
    """Every relation of a program, its rules applied until nothing new follows."""
    from ..plans.planner import Planner
    from ..shared import written

    rel: dict[str, DataFrame] = {}
    for name, rows in program.facts.items():
        rel[name] = spark.createDataFrame([tuple(r) for r in dict.fromkeys(rows)], ", ".join(f"a{i} string" for i in range(len(rows[0]))))
    for _ in range(rounds):
        changed = False
        for (name, args), body in program.rules:
            if any(b not in rel for b, _ in body):
                continue
            clauses = []
            for b, terms in body:
                df = rel[b]
                test = F.lit(True)
                binds: dict[str, Column] = {}
                for i, x in enumerate(terms):
                    c = F.col(f"a{i}")
                    if not _is_variable(x):
                        test &= c == x
                    elif x in binds:
                        test &= c == binds[x]
                    else:
                        binds[x] = c
                clauses.append(t.Table(df, binds or {"_any": F.lit(1)}, test))
            got = Planner().body(clauses).select(*[(F.col(x) if _is_variable(x) else F.lit(x)).alias(f"a{i}") for i, x in enumerate(args)]).distinct()
            new = written(got if name not in rel else got.join(rel[name], got.columns, "left_anti"))
            if not new.isEmpty():
                rel[name] = new if name not in rel else rel[name].unionByName(new)
                changed = True
        if not changed:
            return rel
    raise RecursionError(f"no fixpoint after {rounds} rounds")


def facts_as_atoms(df: DataFrame, predicate: str, columns: list[str]) -> list[DataFrame]:
    """A relation as Edge(predicate, List(arguments)) atom rows, with their nodes."""
    out = [nodes(df.select(F.lit(predicate).alias("n")), "Predicate", "n")]
    args = None
    for c in columns:
        rows = df.select(F.col(c).cast("string").alias("n"))
        args = rows if args is None else args.union(rows)
    out.append(nodes(args, "Concept", "n"))
    ids = F.array(*[node_id(F.lit("Concept"), F.col(c)) for c in columns])
    out.append(links(df, "List", ids))
    out.append(links(df, "Edge", [node_id(F.lit("Predicate"), F.lit(predicate)), F.xxhash64(F.lit("List"), ids)]))
    return out


# ---- s-expressions ---------------------------------------------------------------------------

_SEXPR = re.compile(r"\s+|;[^\n]*|(?P<open>\()|(?P<close>\))|\"(?P<text>(?:[^\"\\]|\\.)*)\"|(?P<word>[^\s()\";]+)")


def parse_sexpr(text: str) -> list[t.Term]:
    """Terms of a text: ``(Type "name")`` is a node, ``(Type term ...)`` a link, ``$x`` a variable."""

    def read(marks: Iterator[re.Match]) -> list:
        out: list = []
        for m in marks:
            if m.lastgroup == "open":
                out.append(build(read(marks)))
            elif m.lastgroup == "close":
                return out
            else:
                out.append(("text", m["text"]) if m.lastgroup == "text" else ("word", m["word"]))
        return out

    def build(parts: list) -> t.Term:
        kind = parts[0][1]
        if len(parts) == 2 and isinstance(parts[1], tuple):
            return t.Node(kind, parts[1][1])
        return t.Link(kind, *[p if not isinstance(p, tuple) else t.Var(p[1]) if p[1].startswith("$") else t.Node("Concept", p[1]) for p in parts[1:]])

    return [x for x in read(m for m in _SEXPR.finditer(text) if m.lastgroup) if not isinstance(x, tuple)]


def rows_of(space: Space, terms: list[t.Term]) -> DataFrame:
    """Atom rows of terms and all that is in them."""
    spark = space.spark
    out: DataFrame | None = None
    by_type: dict[str, list[str]] = {}
    links_: list[t.Link] = []

    def walk(x: t.Term) -> None:
        if isinstance(x, t.Var):
            by_type.setdefault("Variable", []).append(x.name)
        elif isinstance(x, t.Node):
            by_type.setdefault(x.type, []).append(x.name)
        else:
            for y in x.out:
                walk(y)
            links_.append(x)

    for x in terms:
        walk(x)
    for kind, names in by_type.items():
        rows = nodes(spark.createDataFrame([(n,) for n in names], "n string"), kind, "n")
        out = rows if out is None else out.unionByName(rows)

    def id_of(x: t.Term) -> Column:
        if isinstance(x, t.Link):
            ids = F.array(*map(id_of, x.out))
            return F.xxhash64(F.lit(x.type), F.array_sort(ids) if space.lattice.unordered(x.type) else ids)
        return node_id(F.lit("Variable" if isinstance(x, t.Var) else x.type), F.lit(x.name))

    one = spark.range(1)
    for x in dict.fromkeys(links_):
        out = out.unionByName(links(one, x.type, [id_of(y) for y in x.out], space.lattice))
    return out


# ---- JSON --------------------------------------------------------------------------------------


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """Top-level entries of JSON objects: key column, name, value as a string."""
    return df.select(key, F.explode(F.from_json(text, T.MapType(T.StringType(), T.StringType()))).alias("name", "value"))


_DEFINITIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType())]))


@F.pandas_udf(_DEFINITIONS)
def python_definitions(source: pd.Series) -> pd.Series:
    """Functions, classes and imports of Python source texts, by the standard parser; null where it doesn't parse."""
    import ast

    def one(text: str | None) -> list | None:
        try:
            tree = ast.parse(text or "")
        except SyntaxError:
            return None
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        return [{"name": n.name, "kind": kinds[type(n)], "line": n.lineno} for n in ast.walk(tree) if type(n) in kinds]

    return source.map(one)


# ---- export ---------------------------------------------------------------------------------------


def export(space: Space, path: str) -> None:
    """The space as s-expressions, one a line."""
    space.printed().select("sexpr").write.text(path)
