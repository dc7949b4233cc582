"""The typed hypergraph as tables: atoms, the values attached to them, and layers.

``atoms(atom_id, type, is_node, name, outgoing, arity, num)`` and
``values(atom_id, key, vtype, fval, sval, bval)``. An id is a hash of an atom's content, children's
ids included, so equal atoms get equal ids wherever they are made: inserting is a union
without duplicates, and no sequence has to be handed out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .types import Lattice

ATOMS = "atom_id long, type string, is_node boolean, name string, outgoing array<long>, arity int, num array<double>"
VALUES = "atom_id long, key string, vtype string, fval array<double>, sval array<string>, bval array<boolean>"


def node_id(type_: Column, name: Column) -> Column:
    return F.xxhash64(type_, name.cast("string"))


def link_id(type_: str | Column, outgoing: Column, unordered: bool = False) -> Column:
    """The hash of a link's type and its children's ids, sorted first where order doesn't count."""
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return F.xxhash64(kind, F.array_sort(outgoing) if unordered else outgoing)


def nodes(df: DataFrame, type_: str, name: Column | str) -> DataFrame:
    """Atom rows for the distinct names in a table. Numbers also hold their value."""
    n = F.col(name) if isinstance(name, str) else name
    num = F.array(n.cast("double")) if type_ == "Number" else F.lit(None).cast("array<double>")
    out = df.select(n.cast("string").alias("name")).where("name is not null").distinct()
    if type_ == "Number":
        num = F.array(F.col("name").cast("double"))
    return out.select(node_id(F.lit(type_), F.col("name")).alias("atom_id"), F.lit(type_).alias("type"), F.lit(True).alias("is_node"), "name", F.array().cast("array<long>").alias("outgoing"), F.lit(0).alias("arity"), num.alias("num"))


def links(df: DataFrame, type_: str, outgoing: list[Column] | Column, lattice: Lattice | None = None) -> DataFrame:
    """Atom rows for links whose children's ids are given by columns."""
    out = F.array(*outgoing) if isinstance(outgoing, list) else outgoing
    unordered = (lattice or Lattice()).unordered(type_)
    if unordered:
        out = F.array_sort(out)
    rows = df.select(out.cast("array<long>").alias("outgoing")).distinct()
    return rows.select(link_id(type_, F.col("outgoing")).alias("atom_id"), F.lit(type_).alias("type"), F.lit(False).alias("is_node"), F.lit(None).cast("string").alias("name"), "outgoing", F.size("outgoing").alias("arity"), F.lit(None).cast("array<double>").alias("num"))


def values(df: DataFrame, atom: Column, key: str, fval: Column | None = None, sval: Column | None = None, bval: Column | None = None) -> DataFrame:
    kind = "FloatValue" if fval is not None else "StringValue" if sval is not None else "BoolValue"
    none = F.lit(None)
    return df.select(atom.alias("atom_id"), F.lit(key).alias("key"), F.lit(kind).alias("vtype"), (none if fval is None else fval).cast("array<double>").alias("fval"), (none if sval is None else sval).cast("array<string>").alias("sval"), (none if bval is None else bval).cast("array<boolean>").alias("bval"))


@dataclass
class Space:
    """A namespace of atoms and values; every change gives a new space."""

    atoms: DataFrame
    values: DataFrame | None = None
    lattice: Lattice = field(default_factory=Lattice)
    read_only: bool = False
    formulas: dict[str, tuple[str, Callable[[Column], Column]]] = field(default_factory=dict)

    @classmethod
    def empty(cls, spark: SparkSession, lattice: Lattice | None = None) -> Space:
        return cls(spark.createDataFrame([], ATOMS), spark.createDataFrame([], VALUES), lattice or Lattice())

    @classmethod
    def of(cls, *rows: DataFrame, values: list[DataFrame] | None = None, lattice: Lattice | None = None) -> Space:
        """From atom rows whose parts are disjoint already."""
        vals = reduce(DataFrame.unionByName, values) if values else None
        return cls(reduce(DataFrame.unionByName, rows), vals, lattice or Lattice())

    def stored(self) -> Space:
        """The space as a stored table, its atoms in one folder a type, so that a scan by type reads only that."""
        atoms = written(self.atoms, by="type").select(*self.atoms.columns)
        return replace(self, atoms=atoms, values=None if self.values is None else written(self.values))

    @property
    def spark(self) -> SparkSession:
        return self.atoms.sparkSession

    @property
    def edges(self) -> DataFrame:
        """edge(link_id, link_type, pos, child_id)."""
        return self.atoms.where(~F.col("is_node")).select(F.col("atom_id").alias("link_id"), F.col("type").alias("link_type"), F.posexplode("outgoing").alias("pos", "child_id"))

    # -- scans

    def by_type(self, type_: str, subtypes: bool = False) -> DataFrame:
        return self.atoms.where(F.col("type").isin(*sorted(self.lattice.descendants(type_)))) if subtypes else self.atoms.where(F.col("type") == type_)

    def roots(self, type_: str | None = None, subtypes: bool = True) -> DataFrame:
        """Atoms that no link holds."""
        df = self.atoms if type_ is None else self.by_type(type_, subtypes)
        held = self.edges.select(F.col("child_id").alias("atom_id"))
        return df.join(held, "atom_id", "left_anti")

    def counts(self) -> DataFrame:
        return self.atoms.groupBy("type").agg(F.count("*").alias("n"))

    def lookup(self, type_: str, name: str) -> DataFrame:
        return self.atoms.where(F.col("atom_id") == node_id(F.lit(type_), F.lit(name)))

    def lookup_link(self, type_: str, *children: Column) -> DataFrame:
        return self.atoms.where(F.col("atom_id") == link_id(type_, F.array(*children), self.lattice.unordered(type_)))

    def incoming(self, of: DataFrame, type_: str | None = None) -> DataFrame:
        """Links that hold any of ``of`` (atom_id), by child: child_id and the link's columns."""
        hit = self.edges.join(of.select(F.col("atom_id").alias("child_id")).distinct(), "child_id", "left_semi")
        if type_ is not None:
            hit = hit.where(F.col("link_type") == type_)
        return hit.select("child_id", F.col("link_id").alias("atom_id")).distinct().join(self.atoms, "atom_id")

    def named(self, df: DataFrame, *ids: str) -> DataFrame:
        """Adds <column>_name for id columns that hold nodes."""
        for c in ids:
            df = df.join(self.atoms.select(F.col("atom_id").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
        return df

    # -- changes

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the space is read-only")

    def insert(self, rows: DataFrame) -> Space:
        """Find or create; into a read-only space nothing new comes. Different atoms that share an id are an error."""
        if self.read_only:
            return self
        content = F.struct("type", "name", "outgoing")
        names = self.atoms.columns
        each = rows.select(*names).groupBy("atom_id").agg(F.first(F.struct(*names)).alias("_row"), F.min(content).alias("_new"), F.max(content).alias("_other"))
        old = self.atoms.select("atom_id", content.alias("_old"))
        clash = F.raise_error(F.lit("two different atoms have one id")).cast("boolean")
        new = F.when(~F.col("_new").eqNullSafe(F.col("_other")), clash).when(F.col("_old").isNull(), F.lit(True)).when(F.col("_old").eqNullSafe(F.col("_new")), F.lit(False)).otherwise(clash)
        found = each.join(old, "atom_id", "left").where(new).select(*[F.col("_row")[c].alias(c) for c in names])
        return replace(self, atoms=self.atoms.unionByName(found))

    def extract(self, ids: DataFrame, recursive: bool = False) -> Space:
        """Removes atoms that no link holds and that are no key; with recursive, what holds them goes too."""
        self._writable()
        gone = ids.select("atom_id").distinct()
        if recursive:
            from ..operators.containment import upward

            gone = upward(self, gone).select("atom_id").distinct()
        else:
            held = self.edges.select(F.col("child_id").alias("atom_id"))
            gone = gone.join(held, "atom_id", "left_anti")
        if self.values is not None:
            keys = self.values.select(F.col("key").alias("name")).distinct()
            used = self.atoms.where("is_node").join(keys, "name", "left_semi").select("atom_id")
            gone = gone.join(used, "atom_id", "left_anti")
        vals = None if self.values is None else self.values.join(gone, "atom_id", "left_anti").select(*self.values.columns)
        return replace(self, atoms=self.atoms.join(gone, "atom_id", "left_anti").select(*self.atoms.columns), values=vals)

    def set_values(self, rows: DataFrame) -> Space:
        """Upserts (atom_id, key)."""
        self._writable()
        if self.values is None:
            return replace(self, values=rows)
        kept = self.values.join(rows.select("atom_id", "key"), ["atom_id", "key"], "left_anti").select(*self.values.columns)
        return replace(self, values=kept.unionByName(rows))

    def value_of(self, ids: DataFrame, key: str, default: Column | None = None) -> DataFrame:
        """ids with the value at ``key``; without a default, atoms that lack it are left out."""
        source, formula = self.formulas.get(key, (key, None))
        v = self.values.where(F.col("key") == source).select("atom_id", "fval", "sval", "bval")
        if formula is not None:
            v = v.withColumn("fval", formula(F.col("fval")))
        if default is None:
            return ids.join(v, "atom_id")
        return ids.join(v, "atom_id", "left").withColumn("fval", F.coalesce("fval", default))

    def set_formula(self, key: str, source: str, formula: Callable[[Column], Column]) -> Space:
        """Lazy values: those at ``key`` are computed from what is at ``source`` whenever they are read."""
        self._writable()
        return replace(self, formulas={**self.formulas, key: (source, formula)})

    def type_of(self, ids: DataFrame, column: str) -> DataFrame:
        """``ids`` with the type of the atom in ``column``."""
        return ids.join(self.atoms.select(F.col("atom_id").alias(column), F.col("type").alias(f"{column}_type")), column)

    def keys_of(self, ids: DataFrame) -> DataFrame:
        return self.values.join(ids.select("atom_id").distinct(), "atom_id", "left_semi").select("atom_id", "key")

    def increment(self, rows: DataFrame) -> Space:
        """Adds the vectors of ``rows`` (atom_id, key, fval) to what is stored; a missing one counts as zeros."""
        every = self.values.where("fval is not null").select("atom_id", "key", "fval").unionByName(rows.select("atom_id", "key", "fval"))
        each = every.select("atom_id", "key", F.posexplode("fval").alias("pos", "x")).groupBy("atom_id", "key", "pos").agg(F.sum("x").alias("x"))
        total = each.groupBy("atom_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("fval"))
        rows_ = total.select("atom_id", "key", F.lit("FloatValue").alias("vtype"), "fval", F.lit(None).cast("array<string>").alias("sval"), F.lit(None).cast("array<boolean>").alias("bval"))
        return self.set_values(rows_)

    def differs(self, other: Space, with_values: bool = False) -> DataFrame:
        """One row: atoms (and values) on one side only, and whether the spaces are equal."""
        a, b = self.atoms.select("atom_id"), other.atoms.select("atom_id")
        sides = [a.exceptAll(b).select(F.lit("left").alias("side")), b.exceptAll(a).select(F.lit("right").alias("side"))]
        if with_values:
            v, w = self.values, other.values
            sides += [v.exceptAll(w).select(F.lit("left").alias("side")), w.exceptAll(v).select(F.lit("right").alias("side"))]
        return reduce(DataFrame.unionAll, sides).agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"), (F.count("*") == 0).alias("same"))

    def printed(self, depth: int = 3) -> DataFrame:
        """Every atom as an s-expression, children down to ``depth`` levels spelled out."""
        text = self.atoms.where("is_node").select("atom_id", F.concat(F.lit("("), "type", F.lit(' "'), "name", F.lit('")')).alias("sexpr"))
        todo = self.atoms.where(~F.col("is_node"))
        out = text
        for _ in range(depth):
            parts = todo.select("atom_id", "type", "arity", F.posexplode("outgoing").alias("pos", "c")).join(out.select(F.col("atom_id").alias("c"), "sexpr"), "c")
            whole = parts.groupBy("atom_id", "type", "arity").agg(F.array_sort(F.collect_list(F.struct("pos", "sexpr"))).alias("p")).where(F.size("p") == F.col("arity"))
            whole = whole.select("atom_id", F.concat(F.lit("("), "type", F.lit(" "), F.array_join(F.col("p.sexpr"), " "), F.lit(")")).alias("sexpr"))
            out = text.unionByName(whole)
        return out


# ---- layers -------------------------------------------------------------------------------


def resolve(layers: DataFrame, key: list[str], depth: str = "frame", absent: str = "absent") -> DataFrame:
    """What the top of a stack of layers shows: by key the row of the greatest ``depth``, unless it is a tombstone."""
    top = layers.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(depth).desc())))
    return top.where((F.col("_r") == 1) & ~F.coalesce(F.col(absent), F.lit(False))).drop("_r")


def stack(*frames: DataFrame, key: list[str]) -> DataFrame:
    """Layers from the bottom up, as one table with ``frame``; a frame without ``absent`` hides nothing."""
    out = []
    for i, f in enumerate(frames):
        f = f if "absent" in f.columns else f.withColumn("absent", F.lit(False))
        out.append(f.withColumn("frame", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def owner(layers: DataFrame, key: list[str], depth: str = "frame") -> DataFrame:
    """The topmost frame that has each key, visible or hidden there."""
    return layers.groupBy(*key).agg(F.max(depth).alias("owner"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """State: the last write of each key stays."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def earliest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Grant: the first write of each key stays."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def defined_once(df: DataFrame, key: list[str]) -> DataFrame:
    """Define: keys that are defined more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


