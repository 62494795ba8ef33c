"""What plans leave out: broadcasts of exploded rows, copies of sets, shuffles of what is in place."""

import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import concepts as C
from factloom.operators import trees as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_meet_where_their_pair_is(spark):
    r = random.Random(3)
    pairs = [(1, 2), (1, 3), (2, 3), (2, 2), (1, 2), (4, 1), (9, 1)]
    rows = [(t, f"r/{p}", "name", "string", r.choice("xy")) for t in (1, 2, 3, 4) for p in r.choices("abcd", k=4)] + [(1, None, "name", "string", "x"), (2, None, "name", "string", "x")]
    leaves = spark.createDataFrame(rows, "tree int, path string, field string, vtype string, value string")
    d = T.tree_diff(spark.createDataFrame(pairs, "a int, b int"), leaves)
    # trees pass one shuffle to their pairs and none after it, and no rows are broadcast
    assert "Broadcast" not in plan(d) and plan(d).count("Exchange hashpartitioning(a#") == 1
    want = Counter()
    for (a, b), n in Counter(pairs).items():
        left, right = ([x for x in rows if x[0] == t for _ in range(n)] for t in (a, b))
        for x in left:
            met = [y for y in right if y[1] == x[1] and x[1]]
            want.update((a, b, x[1], "shared" if x[4] == y[4] else "identifier", x[4], y[4]) for y in met)
            want.update([(a, b, x[1], "missing-field", x[4], None)] if not met else [])
        want.update((a, b, y[1], "extra-field", None, y[4]) for y in right if not y[1] or y[1] not in [x[1] for x in left])
    assert Counter(map(tuple, d.collect())) == want


def test_scores_take_one_pass(spark):
    leaves = spark.createDataFrame([(t, f"r/{f}", f, "string", v) for t, s in ((1, "A"), (2, "B")) for f, v in (("type", s), ("signature", f"to {s}"), ("name", "n"))], "tree int, path string, field string, vtype string, value string")
    d = T.score(T.tree_diff(spark.createDataFrame([(1, 2)], "a int, b int"), leaves, T.classify_ast))
    assert plan(d).count("Join ") == 1 and "BroadcastHashJoin" not in plan(d)
    assert [(r.shared, r.diff_count, r.derived, r.type_params, r.cost) for r in d.collect()] == [(1, 2, 1, 1, 1)]


def test_similar_sets_of_frequent_keys(spark, monkeypatch):
    r = random.Random(5)
    sets = {i: set(r.sample(range(8), r.randint(1, 6))) for i in range(60)}
    df = spark.createDataFrame([(i, f"k{x}") for i, s in sets.items() for x in s], "item int, key string")
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    own = sorted(first.values())
    near = {(a, b) for a in own for b in own if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 2}
    for most in (0, 20, 1000):
        monkeypatch.setattr(C, "FREQUENT", most)
        d = C.similar_sets(df)
        assert Counter((x.a, x.b) for x in d.where(~F.col("same")).collect()) == Counter(near)
        assert "HashAggregate(keys=[a#" not in plan(d)  # a pair is found once


def test_placed_rows_stay_where_they_are(spark):
    from factloom.operators import paths as P
    from factloom.plans.fixpoint import placed

    e = placed(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None), ("d", "a")], "src string, dst string"), "src")
    assert "Exchange" not in plan(e.groupBy("src").count())
    got = P.reachable(e, spark.createDataFrame([("b",), ("d",), ("x",)], "node string"))
    assert Counter(map(tuple, got.collect())) == Counter([(r, n) for r in "bd" for n in ("a", "b", "c", None)] + [("d", "d")])
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_components_move_nodes_only(spark):
    from factloom.operators import paths as P

    r = random.Random(7)
    for n, m in ((12, 14), (9, 9)):
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)] + [(None, "n0"), ("n1", None)]
        to = {}
        for a, b in pairs:
            if a and b:
                to.setdefault(a, set()).add(b)
        reach = {}
        for a in {x for p in pairs for x in p if x}:
            seen, todo = set(), [a]
            while todo:
                for b in to.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[a] = seen
        e = spark.createDataFrame(pairs, "src string, dst string")
        want = {(a, min([a, *(b for b in reach[a] if a in reach[b])])) for p in pairs if None not in p for a in p}
        assert set(map(tuple, P.components(e).collect())) == want
        assert {x.node for x in P.cyclic_nodes(e).collect()} == {a for a in reach if a in reach[a]}
        es = P.placed(e, "src", distinct=True)
        ends = P._ends(es, P.placed(es, "dst"))
        assert "Exchange" not in plan(ends)  # counts of both ends meet where they lie


def test_settle_shuffles_new_rows_only(spark):
    from factloom.operators import paths as P

    r = random.Random(2)
    rows = [(f"n{r.randrange(15)}", f"n{r.randrange(15)}", r.randint(0, 9)) for _ in range(40)]
    best = {("n0", "n0"): 0}
    for _ in range(20):
        for a, b, w in rows:
            if ("n0", a) in best:
                best["n0", b] = min(best.get(("n0", b), 1 << 30), best["n0", a] + w)
    d = P.tropical(spark.createDataFrame(rows, "src string, dst string, w int"), spark.createDataFrame([("n0",)], "node string"), "w")
    assert {(x.root, x.node): x.distance for x in d.collect()} == best
    assert "Exchange" not in plan(d)  # rows of a node lie together in all rounds


def test_path_counts_end_on_cycles_soon(spark, monkeypatch):
    import pytest

    from factloom.operators import paths as P

    monkeypatch.setattr(P, "ROUNDS", 2)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(4)]
    a = spark.createDataFrame([("n0",)], "node string")
    assert P.count_paths(spark.createDataFrame(chain, "src string, dst string"), a).count() == 5  # more rounds than the look for cycles
    with pytest.raises(ValueError):
        P.count_paths(spark.createDataFrame([*chain, ("n2", "n1")], "src string, dst string"), a)
    assert P.count_paths(spark.createDataFrame([*chain, ("x", "x")], "src string, dst string"), a).count() == 5  # a cycle out of reach


def test_simple_paths_walk_to_their_end_only(spark, monkeypatch):
    from factloom.operators import paths as P

    kept, made = P.checkpointed, []
    monkeypatch.setattr(P, "checkpointed", lambda df: made.append(kept(df)) or made[-1])
    fan = [("a", "b"), ("b", "c")] + [("a", f"x{i}") for i in range(30)] + [(f"x{i}", f"y{i}") for i in range(30)]
    e = spark.createDataFrame(fan, "src string, dst string")
    assert [x.path for x in P.simple_paths(e, "a", "c", 2).collect()] == [["a", "b", "c"]]
    assert P.simple_paths(e, "a", "c", 1).count() == 0
    assert max(d.count() for d in made) < 30  # dead ends aren't walked


def test_candidates_travel_as_lists(spark):
    from factloom.operators import flows as W

    r = random.Random(4)
    uses = [(r.randrange(8), r.randrange(6)) for _ in range(20)] + [(99, 77), (None, 1)]
    makers = [(r.randrange(6), r.randrange(9)) for _ in range(25)] + [(2, None), (5, None)]
    u, m = spark.createDataFrame(uses, "site int, key int"), spark.createDataFrame(makers, "key int, candidate int")
    sites = u.select("site").distinct()
    got = W.narrowed_by(sites, u, m, ["site"], "key")
    wide = W.narrowed_from(sites, u.distinct().join(m.distinct(), "key"), ["site"])
    assert sorted(map(str, got.collect())) == sorted(map(str, wide.collect()))
    assert "Exchange hashpartitioning(site#" in plan(got) and plan(got).count("Generate") == 0  # no pair of site and candidate


def test_locks_carry_masks(spark):
    from factloom.operators import flows as W

    r = random.Random(6)
    locks = [(r.randrange(30), r.randrange(5)) for _ in range(60)] + [(98, 1)]
    points = [(r.randrange(5), f"s{r.randrange(7)}") for _ in range(15)] + [(1, "s9")]
    roots = [(f, f"g{r.randrange(200)}") for f in range(30) for _ in range(5)] + [(3, None)]
    at = {(s, f) for f, v in locks for w, s in points if v == w}
    want = {(s, len({x for g, x in roots if x and (s, g) in at})) for s, _ in at}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = W.lock_escape(frame(locks, "func int, value int"), frame(points, "value int, site string"), frame(roots, "func int, root string"))
    assert {(x.site, x.roots) for x in d.collect()} == want
    assert "hashpartitioning(func#" not in plan(d)  # functions don't meet sites


def test_names_reached_are_masks(spark):
    from factloom.operators import flows as W

    rows = [(f"n{i}", f"n{i + 1}") for i in range(3)] + [("n3", f"t{i}") for i in range(90)] + [("c", "c"), ("b", "c"), ("x", "z"), ("c", "t1")]
    e = spark.createDataFrame(rows, "src string, dst string")
    ends = spark.createDataFrame([(f"t{i}", f"T{i % 70:02}") for i in range(90)] + [("z", None)], "node string, type string")
    got = {x.node: (x.confidence, x.types) for x in W.narrow(e, ends).collect()}
    assert got["n0"] == ("narrow", [f"T{i:02}" for i in range(70)])
    assert got["b"] == got["c"] == ("widened", ["T01"]) and got["x"] == got["z"] == ("narrow", [])
    masks, _ = W.names_reached(W.placed(e, "dst", distinct=True), ends, "type")
    assert masks.where("node = 'n0'").count() == 2  # 70 names in two words


def test_call_sites_of_their_own_need_no_brackets(spark):
    from factloom.operators import flows as W

    c = spark.createDataFrame([(f"a{i}", "p", i) for i in range(5)], "src string, dst string, id int")
    assert W._between(c).isEmpty() and W.balanced(c).count() == 6
    assert {tuple(x) for x in W._between(c.withColumn("id", F.lit(1)).limit(2)).collect()} == {("a0", "a1"), ("a1", "a0")}
    v = W.valid_paths(c, spark.createDataFrame([("a1",), ("q",)], "node string"))
    assert {tuple(x) for x in v.collect()} == {("a1", "a1"), ("a1", "p")}


def test_rows_found_before_stay(spark):
    from factloom.operators import beliefs as B
    from factloom.operators import concepts as C
    from factloom.operators import flows as W

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("c", None)], "src string, dst string")
    n = spark.createDataFrame([("a",)], "node string")
    w = C.propagate_writes(spark.createDataFrame([("c", "x"), (None, "y")], "func string, attribute string"), e)
    assert {tuple(x) for x in w.collect()} == {("a", "x"), ("b", "x"), ("c", "x"), (None, "y")}
    d = W.defuse_reachable(e, n, 2)
    assert {x.node for x in d.collect()} == {"a", "b", "c"}
    p = W.points_to(e, n.selectExpr("node value", "'s' site"))
    assert {x.value for x in p.collect()} == {"a", "b", "c", None}
    for found, on in ((w, "func"), (d, "node"), (p, "value")):
        assert "Exchange" not in plan(found.groupBy(on).count())
    hit = B.reaches_call(spark.createDataFrame([("a",), ("c",), ("z",)], "func string"), e, spark.createDataFrame([("c",)], "node string"))
    assert {tuple(x) for x in hit.collect()} == {("a", "reaches"), ("c", "unreached"), ("z", "unresolved")}
