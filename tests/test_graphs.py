import itertools
import random

import pytest

from factloom.operators import flows as W
from factloom.operators import paths as P


def edges(spark, *e):
    return spark.createDataFrame(list(e), "src string, dst string")


def at(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "node string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_semirings(spark):
    diamond = edges(spark, ("A", "B"), ("B", "C"), ("A", "C"))
    assert ("A", "C", 1) in rows(P.tropical(diamond, at(spark, "A")))
    counts = {r.node: int(r.paths) for r in P.count_paths(diamond, at(spark, "A")).collect()}
    assert counts == {"A": 1, "B": 1, "C": 2}
    assert rows(P.tropical(diamond, at(spark, "nowhere"))) == set()
    with pytest.raises(ValueError):
        P.count_paths(edges(spark, ("A", "B"), ("B", "A")), at(spark, "A"))


def test_reach_and_cycles(spark):
    e = edges(spark, ("A", "B"), ("B", "A"), ("B", "C"), ("D", "D"))
    assert rows(P.reachable(e, at(spark, "A")).select("node")) == {("A",), ("B",), ("C",)}
    assert rows(P.reaching(e, at(spark, "C")).select("node")) == {("A",), ("B",), ("C",)}
    assert rows(P.cyclic_nodes(e)) == {("A",), ("B",), ("D",)}
    assert rows(P.components(e)) == {("A", "A"), ("B", "A"), ("C", "C"), ("D", "D")}
    assert rows(P.simple_paths(e, "A", "C").selectExpr("array_join(path, '')")) == {("ABC",)}


def test_dominators(spark):
    d = P.dominators(edges(spark, ("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "d")), at(spark, "r"))
    assert rows(P.immediate_dominators(d)) == {("a", "r"), ("b", "r"), ("c", "r"), ("d", "c")}


def test_names(spark):
    df = spark.createDataFrame([("pkg.Run",), ("(*pkg.T).Run",), ("Run",), ("pkg.ReRun",)], "name string")
    assert df.where(P.name_matches("name", "Run")).count() == 3
    assert df.where(P.name_matches("name", "pkg.Run")).count() == 1


def valid(calls):
    """Brute force: paths over opens and closes, at most six deep, whose matched ids agree."""
    steps = [(a, b, ("o", i)) for a, b, i in calls] + [(b, a, ("c", i)) for a, b, i in calls]
    found = set()
    for start in {x for a, b, _ in calls for x in (a, b)}:
        todo, seen = [(start, ())], {(start, ())}
        while todo:
            n, stack = todo.pop()
            found.add((start, n))
            for a, b, (k, i) in steps:
                if a != n:
                    continue
                if k == "o":
                    new = (*stack, i) if len(stack) < 6 else None
                elif stack:
                    new = stack[:-1] if stack[-1] == i else None
                else:
                    new = ()
                if new is not None and (b, new) not in seen:
                    seen.add((b, new))
                    todo.append((b, new))
    return found


def test_valid_paths(spark):
    canary = [("a1", "p", 1), ("a2", "p", 1), ("b2", "p", 2)]
    rng = random.Random(5)
    for calls in (canary, [(f"n{a}", f"n{b}", rng.randint(0, 1)) for a, b in itertools.combinations(range(5), 2) if rng.random() < 0.5]):
        assert rows(W.valid_paths(spark.createDataFrame(calls, "src string, dst string, id int"))) == valid(calls)


def test_taint(spark):
    c = spark.createDataFrame([("A", "p", 1), ("B", "p", 2), ("A", "s", 3), ("A", "t", 4), (None, "t", 5)], "src string, dst string, id int")
    assert rows(W.taint_flows(c, at(spark, "A"), at(spark, "B"))) == set()
    assert rows(W.taint_flows(c, at(spark, "s"), at(spark, "t"))) == {("s", "t")}
    assert rows(W.taint_flows(c, at(spark, "s"), at(spark, "t"), at(spark, "A"))) == set()


def test_dispatch(spark):
    e = spark.createDataFrame([("must", "S")] + [("may", x) for x in "ABC"] + [("many", f"t{i}") for i in range(9)], "site string, candidate string")
    every = spark.createDataFrame([("must",), ("may",), ("many",), ("none",)], "site string")
    got = {r.site: (r["class"], r.n, r.detail, r.candidates) for r in W.dispatch_sites(e, ["site"], every=every).collect()}
    assert got["must"] == ("must", 1, "full", ["S"]) and got["may"] == ("may", 3, "full", ["A", "B", "C"])
    assert got["many"] == ("may", 9, "elided", None) and got["none"] == ("none", 0, "full", None)
    wide = W.narrowed_from(W.dispatch_sites(e, ["site"]), e.where("site = 'may'"), ["site"])
    assert {r.site: r.narrowed_from for r in wide.collect()} == {"must": None, "may": 3, "many": None}


def test_dataflow(spark):
    chain = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert rows(W.defuse_reachable(chain, at(spark, "a"), 2).select("node")) == {("a",), ("b",), ("c",)}
    uses = spark.createDataFrame([("d", "x")], "block string, name string")
    kills = spark.createDataFrame([("b", "x")], "block string, name string")
    assert rows(W.liveness(chain, uses, kills)) == {("d", "x"), ("c", "x")}
    defs = spark.createDataFrame([("a", "v")], "block string, name string")
    assert rows(W.reaching_definitions(chain, defs)) == {("b", "v"), ("c", "v"), ("d", "v")}
    pts = W.points_to(chain, spark.createDataFrame([("a", "f::a")], "value string, site string"), spark.createDataFrame([("c",)], "value string"))
    assert ("d", "?") in rows(pts) and ("d", "f::a") in rows(pts)
    roots = spark.createDataFrame([("f", "main"), ("f", "go1")], "func string, root string")
    lock = lambda v: rows(W.lock_escape(spark.createDataFrame([("f", v)], "func string, value string"), pts, roots))
    assert lock("b") == {("f::a", 2, "2")} and lock("d") == {("f::a", 2, "unbounded")}


def test_narrow(spark):
    e = edges(spark, ("a", "t"), ("b", "c"), ("c", "b"), ("x", "y"))
    t = spark.createDataFrame([("t", "T")], "node string, type string")
    got = {r.node: (r.confidence, r.types) for r in W.narrow(e, t).collect()}
    assert got["a"] == ("narrow", ["T"]) and got["b"][0] == "widened" and got["x"] == ("no-paths", [])
