"""Mapping and rewriting: filters with rules, beta reduction over sets, deletion, machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def filter_rule(df: DataFrame, guard: Column | None = None, **conclusions: Column) -> DataFrame:
    """Rows that pass the guard (a null is a failure), each rewritten to the conclusions if there are any."""
    out = df if guard is None else df.where(guard)
    return out.select(*[c.alias(k) for k, c in conclusions.items()]) if conclusions else out


def filter_items(items: Column, guard: Callable[[Column], Column], conclusion: Callable[[Column], Column] | None = None) -> Column:
    """The same inside an array column."""
    kept = F.filter(items, lambda x: F.coalesce(guard(x), F.lit(False)))
    return kept if conclusion is None else F.transform(kept, conclusion)


def put(df: DataFrame, body: Callable[..., Column], args: list[str], admits: Column | None = None, name: str = "result") -> DataFrame:
    """Maps a function over a set of arguments; those of another type are left out."""
    rows = df if admits is None else df.where(admits)
    return rows.select(body(*[F.col(a) for a in args]).alias(name)).distinct()


def delete(df: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    return df.join(found.select(*on).distinct(), on, "left_anti")


def machine(transitions: DataFrame, inputs: DataFrame, start: str, key: list[str], order: list[str], block: Column) -> DataFrame:
    """Runs many finite-state machines side by side over all their inputs: key, state.

    transitions: (state, input, next_state), a machine's definition, which the plan holds.
    inputs: key, ``order``, input. An input without a transition leaves the state. What a
    row of inputs does is a function of states to states, and those compose: each ``block``
    of a machine's inputs (which must grow with the order) is one function, so a machine with
    very many inputs is dealt out, and only its blocks' functions meet.
    """
    rules = [(r["state"], r["input"], r["next_state"]) for r in transitions.collect()]
    states = sorted({start, *(x for a, _, b in rules for x in (a, b))})
    moves = F.create_map(*[F.lit(x) for a, i, b in rules for x in (f"{a}\x1f{i}", b)]) if rules else F.lit(None).cast("map<string,string>")
    same = F.array(*[F.lit(x) for x in states])

    def move(now: Column, x: Column) -> Column:
        return F.transform(now, lambda s: F.coalesce(F.try_element_at(moves, F.concat_ws("\x1f", s, x["input"])), s))

    rows = F.array_sort(F.collect_list(F.struct(*order, F.col("input").alias("input"))))
    each = inputs.withColumn("_block", block).groupBy(*key, "_block").agg(rows.alias("_in"))
    each = each.select(*key, "_block", F.aggregate("_in", same, move).alias("_f"))
    whole = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_block", "_f"))).alias("_fs"))
    done = F.aggregate("_fs", same, lambda now, f: F.transform(now, lambda s: F.element_at(f["_f"], F.array_position(same, s).cast("int"))))
    return whole.select(*key, F.element_at(done, states.index(start) + 1).alias("state"))


def loop(df: DataFrame, test: Column, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Applies ``step`` to the rows that pass ``test`` until none does: a tail-recursive loop, all rows side by side."""
    done: DataFrame | None = None
    for _ in range(rounds):
        now = written(df.withColumn("_go", F.coalesce(test, F.lit(False))))
        over = now.where(~F.col("_go")).drop("_go")
        done = over if done is None else done.unionByName(over)
        df = now.where("_go").drop("_go")
        if df.isEmpty():
            return done
        df = step(df)
    raise RecursionError(f"no end after {rounds} rounds")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest of (a, b, w) by each component's heaviest edge in turn; ties by the endpoints.

    A round picks for every component the heaviest edge that leaves it and joins what those
    connect. As each component picks one, the picks are pointers that end in pairs, and
    doubling them finds each component's new name. Rounds at least halve the components.
    """
    e = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w")))
    label = written(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("c", F.col("node")))
    chosen: DataFrame | None = None
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("c").alias("ca")), label.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        cross = e.join(la, "a").join(lb, "b").where("ca != cb")
        rank = F.struct(F.col("w").alias("w"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), F.col("ca").alias("ca"), F.col("cb").alias("cb"))
        best = written(cross.select(F.col("ca").alias("c"), rank.alias("r")).union(cross.select("cb", rank)).groupBy("c").agg(F.max("r").alias("r")))
        if best.isEmpty():
            return e.limit(0) if chosen is None else chosen
        new = best.select((-F.col("r.a")).alias("a"), (-F.col("r.b")).alias("b"), F.col("r.w").alias("w")).distinct()
        chosen = written(new if chosen is None else chosen.union(new).distinct())
        up = best.select("c", F.when(F.col("r.ca") == F.col("c"), F.col("r.cb")).otherwise(F.col("r.ca")).alias("p"))
        back = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # of a pair that picked each other the lesser is the root
        up = written(up.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            nxt = written(up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", "p", "pp"))
            up = nxt.select("c", F.col("pp").alias("p"))
            if nxt.where("p != pp").isEmpty():
                break
        label = written(label.join(up, "c", "left").select("node", F.coalesce("p", "c").alias("c")))
