"""From clauses to DataFrames.

A body is flattened and sorted into mandatory clauses, alternatives, absences, universal
clauses and tests. Mandatory clauses become one DataFrame each, with a column a variable;
they are joined along shared variables, connected ones first, so a product appears only
where the pattern itself is disconnected, and then with every test that spans the parts as
the join's condition. Absences are anti-joins, universals are one aggregation and a join.
Subclasses may change what a clause matches (``accept``) and in which order parts are joined
(``next_part``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import terms as t
from .space import Space, link_id, node_id
from .types import Signature


#: Rows of a product's right side that meet a left row at once, on average, and the shares in which left rows are dealt to each such block.
BLOCK, SHARES = 4096, 64
#: Absent places of a block that are looked through one by one.
FEW = 8


class PlanError(ValueError):
    pass


def flatten(body: Any) -> list[Any]:
    if isinstance(body, list | tuple):
        return [c for b in body for c in flatten(b)]
    if isinstance(body, t.And | t.Present):
        return flatten(list(body.clauses))
    if isinstance(body, t.Not):
        inner = body.clause
        if isinstance(inner, t.Not):
            return flatten(inner.clause)
        if isinstance(inner, t.Choice):
            raise PlanError("a choice can't be negated")
        if isinstance(inner, t.Absent):
            return flatten(inner.clause)
        if isinstance(inner, t.Exists):
            return [t.Absent(inner.clause)]
        if isinstance(inner, t.Where):
            return [t.Where(inner.vars, lambda *x: ~F.coalesce(inner.test(*x), F.lit(False)), inner.many)]
        return [t.Absent(inner)]
    if isinstance(body, t.Choice) and len(body.branches) == 1:
        return flatten(body.branches[0])
    return [body]


def share_of(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(SHARES)).cast("int")


def every_share() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")


class Planner:
    """Plans bodies over a space (for Match clauses) and any tables."""

    def __init__(self, space: Space | None = None, definitions: dict[str, Any] | None = None):
        self.space = space
        self.definitions = definitions or {}
        self._n = 0

    # -- clauses

    def clause(self, c: Any) -> DataFrame:
        if isinstance(c, str):
            if c not in self.definitions:
                raise PlanError(f"{c} isn't defined")
            return self.body(self.definitions[c])
        if isinstance(c, DataFrame):
            return c
        if isinstance(c, t.Table):
            df = c.df if c.where is None else c.df.where(c.where)
            return df.select(*[(F.col(e) if isinstance(e, str) else e).alias(v) for v, e in c.binds.items()])
        if isinstance(c, t.Match):
            return self.match(c)
        if isinstance(c, t.Choice):
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.body(b) for b in c.branches])
        raise PlanError(f"not a clause: {c!r}")

    def match(self, c: t.Match) -> DataFrame:
        if self.space is None:
            raise PlanError("atom clauses need a space")
        me = c.as_ or f"_m{self._next()}"
        df = self.term(c.term, me)
        if t.variables(c.term):
            # the pattern itself, stored beside the data, is no ground for it
            df = df.where(F.col(me) != self.stored_id(c.term))
        return df if c.as_ else df.drop(me)

    def stored_id(self, term: Any) -> Column:
        """The id that a term has as an atom, its variables being nodes."""
        if isinstance(term, t.Quoted):
            return self.stored_id(term.term)
        if isinstance(term, t.Link):
            return link_id(term.type, F.array(*map(self.stored_id, term.out)), self.space.lattice.unordered(term.type))
        if isinstance(term, t.Node):
            return node_id(F.lit(term.type), F.lit(term.name))
        kind, name = ("Glob", term.name) if isinstance(term, t.Glob) else ("Variable", getattr(term, "name", "_"))
        return node_id(F.lit(kind), F.lit(name))

    def admitted(self, spec: Any) -> DataFrame:
        """atom_id of the atoms that a type or signature admits."""
        atoms = self.space.atoms
        if not isinstance(spec, Signature):
            return atoms.where(spec.admits(F.col("type"))).select("atom_id")
        if self.space.lattice.unordered(spec.type):
            raise PlanError("a signature of an unordered link isn't defined")
        df = atoms.where((F.col("type") == spec.type) & (F.col("arity") == len(spec.children)) & ~F.col("is_node")).select("atom_id", "outgoing")
        for i, child in enumerate(spec.children):
            df = df.join(self.admitted(child).withColumnRenamed("atom_id", "_c"), F.get("outgoing", F.lit(i)) == F.col("_c"), "left_semi")
        return df.select("atom_id")

    def typed(self, df: DataFrame, x: t.Var) -> DataFrame:
        if x.spec is None or (not isinstance(x.spec, Signature) and x.spec.types is None):
            return df
        return df.join(self.admitted(x.spec).withColumnRenamed("atom_id", x.name), x.name, "left_semi")

    def _next(self) -> int:
        self._n += 1
        return self._n

    def term(self, term: Any, me: str) -> DataFrame:
        """Atoms of the shape of ``term``: their id as ``me`` and a column a variable."""
        atoms = self.space.atoms
        if isinstance(term, t.Node):
            return atoms.where(F.col("atom_id") == node_id(F.lit(term.type), F.lit(term.name))).select(F.col("atom_id").alias(me))
        if any(isinstance(x, t.Glob) for x in term.out):
            return self.globbed(term, me)
        df = atoms.where((F.col("type") == term.type) & (F.col("arity") == len(term.out)) & ~F.col("is_node"))
        if self.space.lattice.unordered(term.type):
            return self.unordered(term, me)
        return self.bound(df, term.out, [F.get("outgoing", F.lit(i)) for i in range(len(term.out))], me)

    def named_signs(self, out: Sequence[Any]) -> list[Any]:
        """Placeholders as variables of their own, whose names begin with an underscore."""
        return [t.Var(f"_s{self._next()}", x.spec) if isinstance(x, t.Sign) else x for x in out]

    def bound(self, df: DataFrame, out: Sequence[Any], slots: list[Column], me: str) -> DataFrame:
        cols, inner, typed, cond = {me: F.col("atom_id")}, [], [], []
        for x, slot in zip(self.named_signs(out), slots, strict=True):
            if isinstance(x, t.Quoted):
                x = t.Node("Variable", x.term.name)
            if isinstance(x, t.Node):
                cond.append(slot == node_id(F.lit(x.type), F.lit(x.name)))
            elif isinstance(x, t.Var):
                if x.name in cols:
                    cond.append(slot == cols[x.name])
                else:
                    cols[x.name] = slot
                typed.append(x)
            elif isinstance(x, t.Link):
                name = f"_m{self._next()}"
                cols[name] = slot
                inner.append((name, x))
        if cond:
            df = df.where(reduce(lambda a, b: a & b, cond))
        df = df.select(*[c.alias(k) for k, c in cols.items()])
        for name, x in inner:
            sub = self.term(x, name)
            shared = [name] + [v for v in t.variables(x) if v in df.columns]
            df = df.join(sub, shared).drop(name)
        for x in dict.fromkeys(typed):
            df = self.typed(df, x)
        return df.drop(*[x.name for x in typed if x.name.startswith("_s")])

    def globbed(self, term: t.Link, me: str) -> DataFrame:
        """Every way to cut the outgoing list into the term's slots; a glob is an array column."""
        if self.space.lattice.unordered(term.type):
            return self.unordered(term, me)
        df = self.space.atoms.where((F.col("type") == term.type) & ~F.col("is_node")).select("atom_id", "outgoing", F.lit(0).alias("_at"))
        cols: dict[str, Column] = {}
        rest_low = [sum(x.bounds[0] if isinstance(x, t.Glob) else 1 for x in term.out[i + 1 :]) for i in range(len(term.out))]
        for i, x in enumerate(term.out):
            if isinstance(x, t.Glob):
                low, high = x.bounds
                most = F.size("outgoing") - F.col("_at") - rest_low[i]
                most = most if high is None else F.least(most, F.lit(high))
                last = i == len(term.out) - 1
                if last:
                    n = F.size("outgoing") - F.col("_at")
                    df = df.where((n >= low) & (F.lit(True) if high is None else n <= high)).withColumn("_n", n)
                else:
                    df = df.where(most >= low).withColumn("_n", F.explode(F.sequence(F.lit(low), most)))
                piece = F.slice("outgoing", F.col("_at") + 1, F.greatest(F.col("_n"), F.lit(0)))
                df = df.where(piece == F.col(x.name)) if x.name in cols else df.withColumn(x.name, piece)
                cols[x.name] = F.col(x.name)
                df = df.withColumn("_at", F.col("_at") + F.col("_n")).drop("_n")
            else:
                slot = F.get("outgoing", F.col("_at"))
                df = df.where(slot.isNotNull())
                if isinstance(x, t.Node):
                    df = df.where(slot == node_id(F.lit(x.type), F.lit(x.name)))
                elif isinstance(x, t.Var):
                    df = df.where(slot == F.col(x.name)) if x.name in cols else df.withColumn(x.name, slot)
                    cols[x.name] = F.col(x.name)
                else:
                    raise PlanError("a term with globs may hold nodes, variables and globs")
                df = df.withColumn("_at", F.col("_at") + 1)
        df = df.where(F.col("_at") == F.size("outgoing")).select(F.col("atom_id").alias(me), *cols)
        for x in term.out:
            if isinstance(x, t.Glob | t.Var) and x.spec is not None and x.spec.types is not None:
                ok = self.space.atoms.where(x.spec.admits(F.col("type"))).select(F.col("atom_id").alias("_ok"))
                if isinstance(x, t.Var):
                    df = df.join(ok.withColumnRenamed("_ok", x.name), x.name, "left_semi")
                else:
                    bad = df.select(me, x.name, F.explode(x.name).alias("_ok")).join(ok, "_ok", "left_anti").select(me, x.name)
                    df = df.join(bad, [me, x.name], "left_anti")
        return df

    def unordered(self, term: t.Link, me: str) -> DataFrame:
        """Unordered links that hold the term's children, each in a place of its own; a glob takes the rest, without one there is none.

        Children are taken out of the list one by one, fixed ones first, so rows only
        multiply by the places that a variable can have.
        """
        globs = [x for x in term.out if isinstance(x, t.Glob)]
        if len(globs) > 1:
            raise PlanError("an unordered term may have one glob")
        size = F.col("arity") >= len(term.out) - 1 if globs else F.col("arity") == len(term.out)
        df = self.space.atoms.where((F.col("type") == term.type) & ~F.col("is_node") & size).select("atom_id", F.col("outgoing").alias("_rest"))
        inner, typed = [], []

        def without(at: Column) -> Column:
            return F.concat(F.slice("_rest", 1, at - 1), F.slice("_rest", at + 1, F.greatest(F.size("_rest"), F.lit(1))))

        children = [t.Node("Variable", x.term.name) if isinstance(x, t.Quoted) else x for x in self.named_signs(term.out)]
        for x in sorted(children, key=lambda x: not isinstance(x, t.Node)):
            if isinstance(x, t.Node):
                at = F.array_position("_rest", node_id(F.lit(x.type), F.lit(x.name))).cast("int")
                df = df.withColumn("_at", at).where("_at > 0").withColumn("_rest", without(F.greatest(F.col("_at"), F.lit(1)))).drop("_at")
            elif isinstance(x, t.Var | t.Link):
                name = x.name if isinstance(x, t.Var) else f"_m{self._next()}"
                df = df.select("*", F.posexplode("_rest").alias("_at", "_x"))
                df = df.where(F.col("_x") == F.col(name)) if name in df.columns else df.withColumn(name, F.col("_x"))
                df = df.withColumn("_rest", without(F.col("_at") + 1)).drop("_at", "_x")
                (typed if isinstance(x, t.Var) else inner).append(x if isinstance(x, t.Var) else (name, x))
        for g in globs:
            low, high = g.bounds
            n = F.size("_rest")
            df = df.where((n >= low) & (F.lit(True) if high is None else n <= high)).withColumn(g.name, F.col("_rest"))
        df = df.drop("_rest").withColumnRenamed("atom_id", me)
        for name, x in inner:
            sub = self.term(x, name)
            df = df.join(sub, [name] + [v for v in t.variables(x) if v in df.columns]).drop(name)
        for x in dict.fromkeys(typed):
            df = self.typed(df, x)
        return df.drop(*[x.name for x in typed if x.name.startswith("_s")]).distinct()

    # -- bodies

    def accept(self, clause: Any, df: DataFrame) -> DataFrame:
        """What a clause matched; a subclass may take rows away."""
        return df

    def next_part(self, bound: list[str], parts: list[DataFrame]) -> int | None:
        """Which part to join next: by default the first that shares a variable; None where none does."""
        return next((i for i, p in enumerate(parts) if set(p.columns) & set(bound)), None)

    def as_test(self, c: Any) -> Any:
        """An Evaluation as the test that its predicate makes of its variables."""
        if not isinstance(c, t.Evaluation):
            return c
        p = c.predicate
        if isinstance(p, str):
            if p not in self.definitions:
                raise PlanError(f"{p} isn't defined")
            p = self.definitions[p]
        if isinstance(p, t.Lambda):
            from ..functions.algebra import truth

            if len(p.params) != len(c.vars):
                raise PlanError("wrong number of arguments")
            return t.Where(c.vars, lambda *x, p=p: truth(p.body, dict(zip(p.params, x, strict=True))))
        return t.Where(c.vars, p)

    def body(self, body: Any) -> DataFrame:
        return self.grounded(body)[0]

    def grounded(self, body: Any, asked: Sequence[str] | None = None) -> tuple[DataFrame, bool]:
        """Groundings, and whether they are known to be a set. ``asked``: only these variables are wanted, as a set."""
        clauses = [self.as_test(c) for c in dict.fromkeys(flatten(body))]
        tests = [c for c in clauses if isinstance(c, t.Where | t.Bind | t.Identical)]
        rest = (t.Where, t.Bind, t.Identical, t.Absent, t.Always, t.Exists)
        parts = [self.accept(c, self.clause(c)) for c in clauses if not isinstance(c, rest)]
        if not parts:
            raise PlanError("a body needs a clause that binds variables")
        negated = [(isinstance(c, t.Absent), self.body(c.clause)) for c in clauses if isinstance(c, t.Absent | t.Exists)]
        universal = [c for c in clauses if isinstance(c, t.Always)]
        is_set = False
        df = parts.pop(0)
        df, tests = self.settle(df, tests)
        while parts:
            near = self.next_part(df.columns, parts)
            if near is not None:
                p = parts.pop(near)
                shared = [c for c in p.columns if c in df.columns]
                spans = lambda x: not set(x.vars) <= set(df.columns) and not set(x.vars) <= set(p.columns) and set(x.vars) <= {*df.columns, *p.columns}
                many = any(isinstance(x, t.Where) and x.many and spans(x) for x in tests)
                df = self.dealt_join(df, p, shared) if many else df.join(p, shared)
            else:
                p = parts.pop(0)
                have = set(df.columns) | set(p.columns)
                ready = [x for x in tests if isinstance(x, t.Where) and set(x.vars) <= have]
                same = [x for x in tests if isinstance(x, t.Identical) and {x.left, x.right} <= have]
                tests = [x for x in tests if x not in ready and x not in same]
                cond = [self.test(x) for x in ready] + [F.col(x.left) == F.col(x.right) for x in same]
                used = {*(asked or ()), *[v for _, found in negated for v in found.columns], *[v for c in universal for v in c.by]}
                if cond:
                    df = df.join(p, reduce(lambda a, b: a & b, cond), "inner")
                elif asked is not None and not parts and not tests and used & set(df.columns) and used & set(p.columns):
                    left, right = (x.select(*[v for v in x.columns if v in used]).distinct() for x in (df, p))
                    df, negated = self.set_product(left, right, negated)
                    is_set = set(df.columns) <= set(asked)
                else:
                    df = df.crossJoin(p)
            df, tests = self.settle(df, tests)
        if tests:
            raise PlanError(f"unbound variables in {tests}")
        for absent, found in negated:
            df = self.negate(df, absent, found)
        for c in universal:
            df = self.universal(df, c)
        return df, is_set

    @staticmethod
    def tasks(df: DataFrame) -> int:
        """In how many parts to deal out what grows faster than its bytes, which Spark judges by."""
        return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)

    def dealt_join(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """A join on few values: ``SHARES`` shares of the left rows of each, and each share meets all right rows of its value."""
        n, by = self.tasks(left), [*on, "_share"]
        dealt = left.withColumn("_share", share_of(left)).repartition(n, *by)
        return dealt.join(right.select("*", every_share()).repartition(n, *by).hint("merge"), by).drop("_share")

    @staticmethod
    def negate(df: DataFrame, absent: bool, found: DataFrame) -> DataFrame:
        """Rows with no match among ``found``, or those with one."""
        shared = [v for v in found.columns if v in df.columns]
        if shared:
            return df.join(found.select(*shared).distinct(), shared, "left_anti" if absent else "left_semi")
        some = found.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))  # one row says whether there is any match
        return df.crossJoin(some.where(~F.col("_some") if absent else F.col("_some"))).drop("_some")

    def set_product(self, left: DataFrame, right: DataFrame, negated: list[tuple[bool, DataFrame]]) -> tuple[DataFrame, list[tuple[bool, DataFrame]]]:
        """The product of two sets that share no column, and the negations that are still to be made of it.

        A negation of one side's variables is made of that side. Of the pairs themselves, absences
        are made here: the right side is cut by hash into blocks of about ``BLOCK`` rows, a left row
        meets a block in one row with the places in it that were found, and only the other
        places are unfolded. So what is dealt out and joined is smaller than the product by
        the size of a block, and no task holds more than a block at a time.
        """
        pairs_found, later = [], []
        for absent, found in negated:
            own = [v for v in found.columns if v in left.columns]
            other = [v for v in found.columns if v in right.columns]
            if own and not other:
                left = self.negate(left, absent, found)
            elif other and not own:
                right = self.negate(right, absent, found)
            elif absent and own:
                pairs_found.append((own, other, found))
            else:
                later.append((absent, found))
        if not pairs_found:
            return left.crossJoin(right), later

        n, cols = self.tasks(left), right.columns
        blocks = right.agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).where("_blocks > 0")
        rows = F.array_sort(F.collect_list(F.struct(*cols)))  # in order, so that a row has the same place wherever this is computed
        packed = right.crossJoin(blocks).groupBy(F.pmod(F.xxhash64(*cols), F.col("_blocks")).cast("int").alias("_block")).agg(rows.alias("_rows"))
        placed = packed.select("_block", F.posexplode("_rows").alias("_at", "_row")).select("_block", "_at", "_row.*")
        met = left.crossJoin(blocks).select(*left.columns, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
        none, gone = F.array().cast("array<int>"), []
        for own, other, found in pairs_found:
            gone.append(f"_gone{len(gone)}")
            places = found.select(*own, *other).join(placed, other).groupBy("_block", *own).agg(F.collect_set("_at").alias(gone[-1]))
            met = met.join(places, ["_block", *own], "left")
        met = met.select(*left.columns, "_block", F.flatten(F.array(*[F.coalesce(F.col(g), none) for g in gone])).alias("_gone"))
        met = met.withColumn("_share", share_of(left)).repartition(n, "_block", "_share")
        columns = packed.select("_block", F.sequence(F.lit(0), F.size("_rows") - 1).alias("_all"), *[F.col(f"_rows.{c}").alias(f"_of_{c}") for c in cols])
        columns = columns.select("*", every_share()).repartition(n, "_block", "_share")
        few = F.size("_gone") <= FEW  # these are looked through a place; taking them out of the list costs a hash a place
        left_over = F.when(few, F.col("_all")).otherwise(F.array_except("_all", "_gone"))
        out = met.join(columns.hint("merge"), ["_block", "_share"]).select(*left.columns, *[f"_of_{c}" for c in cols], "_gone", F.explode(left_over).alias("_at"))
        return out.where(~few | ~F.array_contains("_gone", F.col("_at"))).select(*left.columns, *[F.get(f"_of_{c}", F.col("_at")).alias(c) for c in cols]), later

    @staticmethod
    def test(x: t.Where) -> Column:
        return F.coalesce(x.test(*[F.col(v) for v in x.vars]), F.lit(False))

    def settle(self, df: DataFrame, tests: list[Any]) -> tuple[DataFrame, list[Any]]:
        """Applies the tests and bindings whose variables are there."""
        again = True
        while again:
            again = False
            for x in list(tests):
                if isinstance(x, t.Identical):
                    have = [v for v in (x.left, x.right) if v in df.columns]
                    if len(have) == 2:
                        df = df.where(F.col(x.left) == F.col(x.right))
                    elif have:
                        df = df.withColumn(x.right if have[0] == x.left else x.left, F.col(have[0]))
                        again = True
                    if have:
                        tests = [y for y in tests if y is not x]
                elif set(x.vars) <= set(df.columns):
                    tests = [y for y in tests if y is not x]
                    if isinstance(x, t.Where):
                        df = df.where(x.test(*[F.col(v) for v in x.vars]))
                    else:
                        value = x.value(*[F.col(v) for v in x.vars])
                        df = df.where(F.col(x.var) == value) if x.var in df.columns else df.withColumn(x.var, value)
                        again = True
        return df, tests

    def universal(self, df: DataFrame, c: t.Always) -> DataFrame:
        over = self.body(c.over)
        by = list(c.by)
        if c.same:
            failed = over.groupBy(*by).agg((F.min(c.same) != F.max(c.same)).alias("_no")).where("_no").select(*by)
        else:
            failed = over.where(~F.coalesce(c.holds(F.col), F.lit(False))).select(*by).distinct()
        return df.join(failed, by, "left_anti")


# ---- queries ------------------------------------------------------------------------------


def meet(vars_: Sequence[str] | frozenset[str], body: Any, space: Space | None = None, container: str | Callable[[DataFrame], DataFrame] = "set", definitions: dict[str, Any] | None = None, limit: int | None = None) -> DataFrame:
    """Groundings of ``vars_``, in that order; a set of variables has none, so its columns come by name.

    container: a set by default, a bag with "queue", or what a function of the bag makes of
    it (``in_groups``, ``in_order``). An unbound variable is null.
    """
    names = sorted(vars_) if isinstance(vars_, frozenset | set) else vars_
    as_set = not callable(container) and container != "queue"
    df, is_set = Planner(space, definitions).grounded(body, names if as_set else None)
    out = df.select(*[F.col(v) if v in df.columns else F.lit(None).cast("long").alias(v) for v in names])
    if callable(container):
        out = container(out)
    elif as_set and not is_set:
        out = out.distinct()
    return out if limit is None else out.limit(limit)


def query(vars_: Sequence[str], body: Any, rewrites: dict[str, Callable[..., Column]], space: Space | None = None, definitions: dict[str, Any] | None = None) -> DataFrame:
    """A meet, then one column for each rewrite (a function of the variables); results are a set."""
    df = meet(vars_, body, space, "queue", definitions)
    return df.select(*[f(*[F.col(v) for v in vars_]).alias(k) for k, f in rewrites.items()]).distinct()


def query_with_marginals(vars_: Sequence[str], body: Any, rewrites: dict[str, Callable[..., Column]], space: Space | None = None, definitions: dict[str, Any] | None = None) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """A query's results, the distinct values of each variable, and those of each rewrite; the pattern is searched once."""
    found = written(meet(vars_, body, space, "set", definitions))
    out = found.select(*[f(*[F.col(v) for v in vars_]).alias(k) for k, f in rewrites.items()])
    return out.distinct(), marginals(found), marginals(out)


def satisfied(body: Any, space: Space | None = None) -> DataFrame:
    """One row, ``satisfied``: whether any grounding exists."""
    return Planner(space).body(body).limit(1).agg((F.count(F.lit(1)) > 0).alias("satisfied"))


def marginals(df: DataFrame) -> dict[str, DataFrame]:
    """The distinct values of each column of a result."""
    return {c: df.select(c).distinct() for c in df.columns}


def absent_trigger(body: Any, rewrite: DataFrame, space: Space | None = None) -> DataFrame:
    """``rewrite``'s rows if nothing matches ``body``, else none."""
    found = Planner(space).body(body).limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return rewrite.crossJoin(found).where("_n = 0").drop("_n")


def dual(patterns: DataFrame, slots: Sequence[str], ground: DataFrame, on: dict[str, Column] | None = None) -> DataFrame:
    """Inverse query: stored patterns (a null slot is a variable) that match each ground row."""
    cond = reduce(lambda a, b: a & b, [patterns[s].isNull() | (patterns[s] == (on or {}).get(s, ground[s])) for s in slots])
    return ground.join(patterns, cond)


def repeat(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 200) -> DataFrame:
    """Runs ``step`` on its own new rows until there are none: a query that continues itself, at most ``rounds`` times."""
    seen, new = start.distinct(), start.distinct()
    for _ in range(rounds):
        new = written(step(new).distinct().join(seen, seen.columns, "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise PlanError(f"no end after {rounds} rounds")
