"""The object interface and term reduction."""

import pytest

from hyperloom.api import Graph
from hyperloom.functions.algebra import number, reduce_term
from hyperloom.plans.terms import Glob, Link, Match, Node, Var


def test_graph(spark):
    g = Graph(spark)
    a, b = g.add_node("Concept", "a"), g.add_node("Concept", "b")
    ab = g.add_link("List", a, b)
    assert g.size() == 3 and g.contains(Link("List", a.term, b.term)) and ab.arity == 2
    a.set_value("weight", [1.0, 2.0])
    a.set_value("tag", ["x"])
    assert a.get_value("weight") == [1.0, 2.0] and a.get_value("none") is None and a.get_keys() == ["tag", "weight"]
    assert a.incoming("List").count() == 1 and a.incoming("Set").isEmpty()
    assert not g.remove(a) and g.remove(a, recursive=True) and g.size() == 1
    g.clear()
    assert g.size() == 0


def test_execute(spark):
    g = Graph(spark)
    term = Link("Plus", Node("Number", "1 2 3"), Link("Times", number(2), Node("Number", "5")))
    assert g.execute(term) == [11.0, 12.0, 13.0]
    with pytest.raises(ValueError, match="free"):
        g.execute(Link("Plus", Var("x"), number(1)))


def test_layers(spark):
    g = Graph(spark)
    g.add_node("Concept", "a")
    top = g.child()
    top.add_node("Concept", "b")
    assert (g.size(), top.size()) == (1, 2)


def test_sparse_match(spark):
    g = Graph(spark)
    n = [g.add_node("Concept", x) for x in "abcd"]
    g.add_link("Set", *n)
    g.add_link("Set", n[0], n[1])
    got = g.meet(["x", "r"], [Match(Link("Set", n[0].term, Var("x"), Glob("r")))]).collect()
    assert sorted(len(r["r"]) for r in got) == [2, 2, 2]


def test_reduction():
    x, y = Var("x"), Var("y")
    assert reduce_term(Link("Minus", x, x)) == number(0)
    assert reduce_term(Link("Times", Link("Plus", x, y), number(2))) == reduce_term(Link("Plus", x, y, y, x))
    assert reduce_term(Link("Plus", number(1), number(2))) == number(3)
    assert reduce_term(Link("Sine", Link("Plus", x, x))) == Link("Sine", Link("Times", number(2), x))
