"""Containment searches: what holds given atoms, at any depth, and its least and greatest elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.space import Space, link_id
from ..shared import written


def upward(space: Space, start: DataFrame, rounds: int = 100) -> DataFrame:
    """(start_id, atom_id) of every atom of ``start`` and all that contains it; a round climbs one level.

    Only the newest level meets the edges in a round, and levels are written, so the plan
    doesn't grow with the depth.
    """
    edges = space.edges.select(F.col("child_id").alias("atom_id"), F.col("link_id").alias("up"))
    new = start.select(F.col("atom_id").alias("start_id"), "atom_id").distinct()
    seen = new
    for _ in range(rounds):
        new = written(new.join(edges, "atom_id").select("start_id", F.col("up").alias("atom_id")).distinct().join(seen, ["start_id", "atom_id"], "left_anti"))
        if new.isEmpty():
            return written(seen)
        seen = seen.unionByName(new)
    raise RecursionError(f"containment is deeper than {rounds}")


def upper_set(space: Space, *terms: DataFrame) -> DataFrame:
    """Atoms that contain at least one atom of each term (a DataFrame of atom_id)."""
    sets = [upward(space, x).select("atom_id").distinct() for x in terms]
    return reduce(lambda a, b: a.join(b, "atom_id", "left_semi"), sets)


def minimal_join(space: Space, *terms: DataFrame) -> DataFrame:
    """The upper set without links that directly hold another of its members."""
    upper = upper_set(space, *terms)
    inside = space.edges.join(upper.select(F.col("atom_id").alias("child_id")), "child_id", "left_semi").select(F.col("link_id").alias("atom_id"))
    return upper.join(inside, "atom_id", "left_anti")


def maximal_join(space: Space, *terms: DataFrame) -> DataFrame:
    """The members of the upper set that nothing contains."""
    held = space.edges.select(F.col("child_id").alias("atom_id"))
    return upper_set(space, *terms).join(held, "atom_id", "left_anti")


def constrained(space: Space, found: DataFrame, types: list[str] | None = None, test: Column | None = None) -> DataFrame:
    """Containers of the given types that pass a test on their own columns."""
    rows = space.atoms.join(found.select("atom_id"), "atom_id", "left_semi")
    if types is not None:
        rows = rows.where(F.col("type").isin(*types))
    return rows if test is None else rows.where(test)


def replaced(space: Space, found: DataFrame, old: Column, new: Column) -> DataFrame:
    """The containers with one child in place of another: atom_id, its new outgoing list and new id."""
    rows = space.atoms.join(found.select("atom_id"), "atom_id", "left_semi").where(~F.col("is_node"))
    out = F.transform("outgoing", lambda c: F.when(c == old, new).otherwise(c))
    return rows.select("atom_id", "type", out.alias("outgoing")).withColumn("new_id", link_id(F.col("type"), F.col("outgoing")))


def replace_in(space: Space, found: DataFrame, old: Column, new: Column) -> Space:
    """The space with the containers' replaced forms inserted beside them."""
    made = replaced(space, found, old, new)
    rows = made.select(F.col("new_id").alias("atom_id"), "type", F.lit(False).alias("is_node"), F.lit(None).cast("string").alias("name"), "outgoing", F.size("outgoing").alias("arity"), F.lit(None).cast("array<double>").alias("num"))
    return space.insert(rows)


def roots_of(space: Space, start: DataFrame) -> DataFrame:
    """(start_id, atom_id): the outermost atoms that each start atom is in."""
    held = space.edges.select(F.col("child_id").alias("atom_id"))
    return upward(space, start).join(held, "atom_id", "left_anti").select("start_id", "atom_id")


def closure(edges: DataFrame, start: DataFrame, rounds: int = 100) -> DataFrame:
    """(start, node) reachable along ``edges`` (a, b) from ``start`` (node), itself excluded."""
    new = start.select(F.col("node").alias("start"), "node").distinct()
    seen = None
    for _ in range(rounds):
        step = new.join(edges.select(F.col("a").alias("node"), "b"), "node").select("start", F.col("b").alias("node")).distinct()
        new = written(step if seen is None else step.join(seen, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return new if seen is None else seen
        seen = new if seen is None else seen.unionByName(new)
    raise RecursionError(f"paths are longer than {rounds}")
