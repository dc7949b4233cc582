"""Result collections: sets, bags, groups and sorted ones, and what runs over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniset(df: DataFrame) -> DataFrame:
    return df.distinct()


def grouped(df: DataFrame, key: list[str], items: list[str], count: str = "n") -> DataFrame:
    """Buckets by an equivalence given as key columns: the set of items of each and their number.

    Only key equality is offered: a relation that isn't an equivalence would make the
    buckets depend on the order of arrival.
    """
    item = F.struct(*items) if len(items) > 1 else F.col(items[0])
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias("items")).withColumn(count, F.size("items").cast("long"))


def sorted_values(df: DataFrame, *order: Column, ties: str = "keep", key: list[str] | None = None, take: int | None = None) -> DataFrame:
    """In order; a strict order collapses ties (``ties="collapse"``, by ``key``). ``take`` reads the first ones only."""
    if ties == "collapse":
        df = df.dropDuplicates(key)
    df = df.orderBy(*order)
    return df if take is None else df.limit(take)


def in_groups(key: list[str], items: list[str], count: str = "n") -> Callable[[DataFrame], DataFrame]:
    """A container for a meet: its results in groups."""
    return lambda df: grouped(df, key, items, count)


def in_order(*order: Column, ties: str = "keep", key: list[str] | None = None, take: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A container for a meet: its results sorted."""
    return lambda df: sorted_values(df, *order, ties=ties, key=key, take=take)


def collection_of(df: DataFrame, key: list[str], item: str, kind: str = "Set", name: str = "items") -> DataFrame:
    """Items by key re-wrapped as the named kind: sets have no repetitions and no order, lists and queues keep both."""
    if kind in ("Set", "UnisetValue"):
        return df.groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias(name))
    if kind in ("List", "QueueValue", "LinkValue"):
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias(name))
    if kind == "SortedValue":
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(item), asc=False).alias(name))
    raise ValueError(f"{kind} isn't a collection")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs).distinct()


def intersect(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), dfs)


def subtract(a: DataFrame, b: DataFrame, lists: bool = False) -> DataFrame:
    """Set difference, or with ``lists`` one that takes one occurrence for each."""
    b = b.select(*a.columns)
    return a.exceptAll(b) if lists else a.subtract(b)


def random_choice(df: DataFrame, weight: Column | None = None, n: int = 1, seed: int = 43) -> DataFrame:
    """``n`` rows drawn without replacement, uniformly or by weight (exponential races)."""
    w = F.lit(1.0) if weight is None else weight
    race = F.when(w > 0, -F.log(F.lit(1.0) - F.rand(seed)) / w)
    return df.withColumn("_race", race).where("_race is not null").orderBy("_race").limit(n).drop("_race")


def markov_step(state: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of a chain: state (node, p), edges (a, b, w) to the new state."""
    return state.join(edges, state["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def exclusive_search(domains: list[tuple[str, DataFrame]], different: list[tuple[str, str]], fixed: dict[str, Column] | None = None) -> DataFrame:
    """Assignments of variables to values of their domains (DataFrames of ``value``) in which the
    given pairs differ. Variables come in by number of constraints on those that are in, so
    every join prunes; a known value narrows its domain before it joins."""
    fixed = fixed or {}
    left = dict(domains)
    order: list[str] = []
    while left:
        v = max(left, key=lambda x: (x in fixed, sum((a == x and b in order) or (b == x and a in order) for a, b in different)))
        order.append(v)
        left.pop(v)
    doms = dict(domains)
    out: DataFrame | None = None
    for v in order:
        d = doms[v].select(F.col("value").alias(v))
        if v in fixed:
            d = d.where(F.col(v) == fixed[v])
        if out is None:
            out = d
            continue
        rivals = sorted({x for pair in different if v in pair for x in pair if x != v and x in out.columns})
        # the domain comes as one array beside each row, so partitions don't multiply, and one
        # membership test prunes: chains of inequalities would make the optimizer infer from every pair
        out = out.crossJoin(d.agg(F.collect_set(v).alias("_d"))).withColumn(v, F.explode("_d")).drop("_d")
        if rivals:
            out = out.where(~F.array_contains(F.array(*rivals), F.col(v)))
    return out
