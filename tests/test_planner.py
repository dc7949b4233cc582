"""Patterns, frames, containment and grammars on small golden inputs."""

import pytest
from pyspark.sql import functions as F

from hyperloom.operators import collections as coll
from hyperloom.plans import planner, space
from hyperloom.plans.space import Space
from hyperloom.plans.terms import Absent, Always, Choice, Glob, Link, Match, Node, Not, Table, Var, Where, alpha_equal, canonical
from hyperloom.plans.types import Lattice, TypeSpec
from hyperloom.sources import text as src


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def pets(spark):
    inh = spark.createDataFrame([("Fritz", "German"), ("cat", "pet"), ("dog", "pet"), ("Hank", "American")], "x string, y string")
    keep = spark.createDataFrame([("German", "dog")], "who string, what string")
    return inh, keep


def test_absent_over_a_product(pets):
    inh, keep = pets
    body = [Table(inh, {"who": "y"}, "y <> 'pet'"), Table(inh, {"what": "x"}, "y = 'pet'"), Absent(Table(keep, {"who": "who", "what": "what"}))]
    assert rows(planner.meet(["who", "what"], body)) == {("German", "cat"), ("American", "cat"), ("American", "dog")}


def test_always_same_colour(spark):
    balls = spark.createDataFrame([("r1", "A", "red"), ("r2", "A", "red"), ("g1", "B", "green"), ("r3", "B", "red"), ("y1", "C", "yellow")], "ball string, basket string, colour string")
    one = Table(balls, {"b": "basket"})
    same = Always(Table(balls, {"b": "basket", "c": "colour"}), ("b",), same="c")
    assert rows(planner.meet(["b"], [one, same])) == {("A",), ("C",)}
    red = Always(Table(balls, {"b": "basket", "c": "colour"}), ("b",), lambda c: c("c") == "red")
    assert rows(planner.meet(["b"], [one, red])) == {("A",)}


def test_theta_join_is_no_product(spark):
    df = spark.createDataFrame([("a", 500000.0), ("b", 1000.0), ("c", 200.0), ("d", 310.0)], "w string, n double")
    out = planner.meet(["x", "y"], [Table(df, {"x": "w", "nx": "n"}), Table(df, {"y": "w", "ny": "n"}), Where(("nx", "ny"), lambda a, b: a > b)])
    assert rows(out) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("d", "c")}


def test_choice_leaves_unbound_null(spark):
    a = spark.createDataFrame([(1, 2)], "p int, q int")
    out = planner.meet(["p", "q"], Choice(Table(a, {"p": "p"}), Table(a, {"p": "p", "q": "q"})))
    assert rows(out) == {(1, None), (1, 2)}


def test_negated_choice_is_an_error(spark):
    a = Table(spark.createDataFrame([(1,)], "p int"), {"p": "p"})
    with pytest.raises(planner.PlanError):
        planner.meet(["p"], [a, Not(Choice(a, Table(a.df, {"p": "p"})))])


@pytest.fixture(scope="module")
def sentences(spark):
    g = Space.empty(spark)
    w = [Node("Concept", x) for x in "I really really love you".split()]
    data = [Link("List", w[0], w[3], w[4]), Link("List", w[0], w[1], w[1], w[3], w[4]), Link("List", w[0], w[4]), Link("Similarity", w[0], w[3], w[4]), Link("List", w[0], Link("List", w[3], w[4]))]
    return g.insert(src.rows_of(g, data)).stored()


def test_glob(sentences):
    i, love, you = (Node("Concept", x) for x in ("I", "love", "you"))
    out = planner.meet(["g"], [Match(Link("List", i, Glob("g"), you))], sentences)
    assert sorted(len(r["g"]) for r in out.collect()) == [1, 3]
    out = planner.meet(["g"], [Match(Link("List", i, Glob("g", TypeSpec.interval(0, 1)), you))], sentences)
    assert sorted(len(r["g"]) for r in out.collect()) == [0, 1]
    out = planner.meet(["g", "h"], [Match(Link("List", Glob("g"), love, Glob("h")))], sentences)
    assert sorted(len(r["g"]) for r in out.collect()) == [1, 3]


def test_unordered(sentences):
    out = planner.meet(["x", "y"], [Match(Link("Similarity", Var("x"), Node("Concept", "I"), Var("y")))], sentences)
    got = rows(sentences.named(out, "x", "y").select("x_name", "y_name"))
    assert got == {("love", "you"), ("you", "love")}


def test_nested(sentences):
    out = planner.meet(["x"], [Match(Link("List", Node("Concept", "I"), Link("List", Var("x"), Node("Concept", "you"))))], sentences)
    assert rows(sentences.named(out, "x").select("x_name")) == {("love",)}


def test_insert_is_idempotent_and_ids_are_unique(sentences):
    again = sentences.insert(sentences.atoms)
    assert again.atoms.count() == sentences.atoms.count() == again.atoms.select("atom_id").distinct().count()


def test_frames(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    top = spark.createDataFrame([(1, "A", False), (2, None, True)], "k int, v string, absent boolean")
    assert rows(space.resolve(space.stack(base, top, key=["k"]), ["k"]).select("k", "v")) == {(1, "A"), (3, "c")}


def test_increment_pads(spark):
    g = Space.empty(spark)
    add = spark.createDataFrame([(1, "c", [1.0]), (1, "c", [1.0, 2.0])], "atom_id long, key string, fval array<double>")
    g = g.increment(add).increment(add)
    assert g.values.first()["fval"] == [4.0, 4.0]


def test_read_only(spark):
    g = Space.empty(spark)
    g.read_only = True
    assert g.insert(src.rows_of(g, [Node("Concept", "a")])).atoms.isEmpty()
    with pytest.raises(PermissionError):
        g.set_values(g.values)


def test_alpha(spark):
    assert alpha_equal(Link("List", Var("a"), Var("b")), Link("List", Var("x"), Var("y")))
    assert not alpha_equal(Link("List", Var("a"), Var("b")), Link("List", Var("x"), Var("x")))
    assert canonical(Link("List", Var("a"), Node("Concept", "a"))).out[1] == Node("Concept", "a")


def test_lattice():
    lat = Lattice().declare("Cat", "Concept")
    assert lat.is_a("Cat", "Atom") and not lat.is_a("Node", "Cat")
    with pytest.raises(ValueError):
        lat.declare("Concept", "Cat")


def test_exclusive_search(spark):
    digits = spark.createDataFrame([(i,) for i in range(1, 5)], "value int")
    cells = [f"c{r}{c}" for r in range(2) for c in range(2)]
    diff = [(a, b) for i, a in enumerate(cells) for b in cells[i + 1 :]]
    out = coll.exclusive_search([(c, digits) for c in cells], diff, {"c00": F.lit(1)})
    assert out.count() == 6


def test_strict_sort_collapses(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert coll.sorted_values(df, F.col("k"), ties="collapse", key=["k"]).count() == 2
    assert coll.sorted_values(df, F.col("k")).count() == 3


def test_json_split(spark):
    from hyperloom.functions.text import json_split

    df = spark.createDataFrame([('{"a": [1, 2.50, null], "b": {"c": "x"}} tail',), ("nope",), (None,)], "s string")
    assert [r[0] for r in df.select(json_split("s")).collect()] == ['[["a", ["1", "2.50", "null"]], ["b", [["c", "x"]]]]', None, None]


def test_tests_of_one_variable_all_count(spark):
    """Random bodies of several tests on the same variables, against plain Python."""
    import random

    rng = random.Random(3)
    data = [(i, i * 7 % 13) for i in range(30)]
    df = spark.createDataFrame(data, "a int, b int")
    ops = [(lambda k: (lambda x: x > k)), (lambda k: (lambda x: x < k)), (lambda k: (lambda x: x != k)), (lambda k: (lambda x: x % 3 == k % 3))]
    for _ in range(6):
        tests = [(rng.choice("ab"), rng.choice(ops)(rng.randrange(13))) for _ in range(rng.randrange(1, 5))]
        body = [Table(df, {"a": "a", "b": "b"}), *[Where((v,), f) for v, f in tests]]
        want = {(a, b) for a, b in data if all(f({"a": a, "b": b}[v]) for v, f in tests)}
        assert rows(planner.meet(["a", "b"], body)) == want


def test_specs_count_in_equality():
    lat = Lattice()
    a, b = Var("x", TypeSpec.exact("Concept")), Var("x", TypeSpec.inherits(lat, "Node"))
    assert a != b and a == Var("x", TypeSpec.exact("Concept")) and len({a, b, Var("x")}) == 3
    assert not alpha_equal(Link("List", a), Link("List", b))


def test_different_atoms_of_one_id_are_an_error(spark):
    g = Space.empty(spark)
    g = g.insert(src.rows_of(g, [Node("Concept", "a")]))
    wrong = src.rows_of(g, [Node("Concept", "b")]).withColumn("atom_id", F.lit(g.atoms.first()["atom_id"]))
    with pytest.raises(Exception, match="two different atoms"):
        g.insert(wrong).atoms.collect()


def test_unordered_of_any_size(spark):
    lat = Lattice()
    g = Space.empty(spark)
    letters = [Node("Concept", x) for x in "abcdef"]
    g = g.insert(src.rows_of(g, [Link("Set", *letters), Link("Set", *letters[:5])])).stored()
    out = planner.meet(["x", "y"], [Match(Link("Set", *letters[:4], Var("x"), Var("y")))], g)
    assert rows(g.named(out, "x", "y").select("x_name", "y_name")) == {("e", "f"), ("f", "e")}
    assert lat.unordered("Set")


def test_scope_on_columns(spark):
    from hyperloom.functions import scope

    df = spark.createDataFrame([("(L $a $b $a)",), ("(L $b $a $b)",), ("(L $a $a $b)",), ("(L a)",), (None,)], "t string")
    got = [tuple(r) for r in df.select(scope.canonical(F.col("t")), scope.is_closed(F.col("t"))).collect()]
    assert got == [("(L #0 #1 #0)", False), ("(L #0 #1 #0)", False), ("(L #0 #0 #1)", False), ("(L a)", True), (None, False)]


def test_store_messages(spark, tmp_path):
    from hyperloom.sources.store import Store

    store = Store(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        store.send("read", "t")
    store.send("open")
    store.send("write", "t", spark.range(3))
    assert store.send("read", "t").count() == 3 and store.send("delete", "t") and not store.send("delete", "t")
    with pytest.raises(ValueError):
        store.send("dance")


@pytest.mark.parametrize("block, few", [(1, 8), (3, 1), (4096, 8), (4096, 1)])
def test_absent_pairs_of_a_product(spark, monkeypatch, block, few):
    """Absences of a product's pairs are taken out before it is unfolded, by no anti-join: nulls, repeated rows, one side's absences, further columns."""
    monkeypatch.setattr(planner, "BLOCK", block, raising=False)
    monkeypatch.setattr(planner, "FEW", few, raising=False)
    a = [(i % 7 if i % 5 else None, i % 3) for i in range(30)]
    b = [(i % 11 if i % 6 else None,) for i in range(40)]
    gone = [(i % 7, i % 11 if i % 4 else None) for i in range(0, 60, 3)] * 2
    more = [(i % 3, i % 11) for i in range(7)]
    left, right = spark.createDataFrame(a, "x int, k int"), spark.createDataFrame(b, "y int")
    pairs, kinds = spark.createDataFrame(gone, "x int, y int"), spark.createDataFrame(more, "k int, y int")
    sevens = spark.createDataFrame([(7,)], "y int")
    body = [Table(left, {"x": "x", "k": "k"}), Table(right, {"y": "y"}), Absent(Table(pairs, {"x": "x", "y": "y"})), Absent(Table(kinds, {"k": "k", "y": "y"})), Absent(Table(sevens, {"y": "y"}))]
    want = {(x, k, y) for x, k in a for (y,) in b if (x, y) not in {g for g in gone if None not in g} and (k, y) not in set(more) and y != 7}
    for names in (["x", "k", "y"], ["y", "x"]):
        df = planner.meet(names, body)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got))
        assert set(got) == {tuple({"x": x, "k": k, "y": y}[n] for n in names) for x, k, y in want}
    two = planner.meet(["x", "y"], [Table(left, {"x": "x"}), Table(right, {"y": "y"}), Absent(Table(pairs, {"x": "x", "y": "y"}))])
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("Generate") < plan.index("Aggregate")  # nothing above unfolds again
    assert planner.meet(["x", "y"], [Table(left, {"x": "x"}), Table(right, {"y": "y"}, "y > 99"), Absent(Table(pairs, {"x": "x", "y": "y"}))]).isEmpty()
