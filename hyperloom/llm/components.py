"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (columns a, b: long): comp is the least node of its component.

    Each round every node that has a smaller neighbour takes the least one as its parent,
    parents are followed one step, and the edges are rewritten to what they lead to;
    the edges that are left join different trees. All of it is aggregations and joins on
    distributed tables, written after each round; the driver only learns whether edges remain.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cluster.materialise(e)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    labels: DataFrame | None = None
    while True:
        # written before it meets itself: a parent of many nodes is a hot key there, which
        # Spark can split where both sides of the join come straight from a table
        parent = cluster.materialise(e.groupBy("a").agg(F.min("b").alias("p")))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = cluster.materialise(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        if labels is None:
            labels = nodes.join(parent, nodes["node"] == parent["a"], "left").select("node", F.coalesce("p", "node").alias("comp"))
        else:
            labels = labels.join(parent, labels["comp"] == parent["a"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
        pa, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = e.join(pa, "a").join(pb, "b", "left").select(F.col("pa").alias("x"), F.coalesce("pb", "b").alias("y"))
        e = cluster.materialise(e.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if e.isEmpty():
            return cluster.materialise(labels)
        labels = cluster.materialise(labels)
