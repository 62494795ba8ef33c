"""Sites, instructions, dominance, components, similar sets: on small programs and against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import beliefs as B
from factloom.operators import concepts as C
from factloom.operators import domains as D
from factloom.operators import flows as W
from factloom.operators import kernels as K
from factloom.operators import paths as P
from factloom.operators import sites as S
from factloom.operators import ssa as V
from factloom.operators import trees as T
from factloom.plans import analyzers as A
from factloom.sources.catalog import SCHEMAS, FactCatalog


def rows(df):
    return {tuple(r) for r in df.collect()}


def edges(spark, *e):
    return spark.createDataFrame(list(e), "src int, dst int")


def instr(spark, *ins):
    names = [c.split()[0] for c in SCHEMAS["instr"].split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in ins], SCHEMAS["instr"])


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    for n, m in ((12, 14), (12, 24), (20, 26)):
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = np.zeros((n, n), bool)
        for a, b in e:
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k], :]
        seen = {x for p in e for x in p}
        both = (reach & reach.T) | np.eye(n, dtype=bool)
        df = edges(spark, *e)
        assert rows(P.components(df)) == {(i, int(np.flatnonzero(both[i])[0])) for i in seen}
        assert rows(P.cyclic_nodes(df)) == {(i,) for i in range(n) if reach[i, i]}


def test_function_dominators_against_removal(spark):
    rng = random.Random(4)
    table, want = [], set()
    for f in range(12):
        n = rng.randrange(1, 9)
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}

        def reach(without, e=e):
            seen, todo = set(), [0] if without != 0 else []
            while todo:
                x = todo.pop()
                if x in seen or x == without:
                    continue
                seen.add(x)
                todo += [b for a, b in e if a == x]
            return seen

        table += [(f, a, b) for a, b in e]
        inside = reach(None)
        want |= {(f, x, d) for x in inside for d in inside if x not in reach(d)}
    e = spark.createDataFrame(table, "func int, src int, dst int")
    entry = spark.createDataFrame([(f, 0) for f in range(12)], "func int, node int")
    got = rows(K.dominators(e, entry))
    assert got == want
    strict = {(f, x, d) for f, x, d in got if x != d}
    idom = {(f, x): d for f, x, d in rows(K.idoms(e, entry))}
    for (f, x), d in idom.items():
        assert (f, x, d) in strict and all((f, d, o) in got for g, y, o in strict if (g, y) == (f, x))
    chain = spark.createDataFrame([("ok", 0, None), ("ok", 1, 0), ("bad", 0, None), ("bad", 1, 2), ("bad", 2, 1)], "func string, block int, idom int")
    assert rows(K.broken_dominance(chain)) == {("bad",)}


def test_gen_kill_against_iteration(spark):
    rng = random.Random(5)
    for forward in (True, False):
        e = [(0, rng.randrange(8), rng.randrange(8)) for _ in range(14)]
        g = [(0, rng.randrange(8), rng.choice("xyz")) for _ in range(5)]
        k = [(0, rng.randrange(8), rng.choice("xyz")) for _ in range(5)]
        into = {b: set() for b in range(8)}
        for _ in range(30):
            for b in range(8):
                if forward:
                    into[b] = {n for _, s, d in e if d == b for n in (into[s] - {x for _, y, x in k if y == s}) | {x for _, y, x in g if y == s}}
                else:
                    into[b] = {x for _, y, x in g if y == b} | ({n for _, s, d in e if s == b for n in into[d]} - {x for _, y, x in k if y == b})
        kinds = "func int, block int, name string"
        got = rows(K.gen_kill(spark.createDataFrame(e, "func int, src int, dst int"), spark.createDataFrame(g, kinds), spark.createDataFrame(k, kinds), forward))
        assert got == {(0, b, n) for b, ns in into.items() for n in ns}


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(6)
    sets = {i: frozenset(rng.choices("abcdefghij", weights=[20, 5, 5, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(1, 6))) for i in range(90)}
    df = spark.createDataFrame([(i, k) for i, s in sets.items() for k in s] + [(None, "a"), (1, None)], "item int, key string")
    for p, q in ((2, 5), (3, 5), (1, 1), (1, 10)):
        first = {}
        for i in sorted(sets):
            first.setdefault(sets[i], i)
        want = {(first[s], i, 1.0, True) for i, s in sets.items() if first[s] != i}
        for (s, i), (t, j) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2):
            if len(s & t) * q >= len(s | t) * p:
                want.add((i, j, len(s & t) / len(s | t), False))
        assert rows(C.similar_sets(df, (p, q))) == want


def test_frontier_of_many_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (1500, 3))
    df = spark.createDataFrame([(int(i), *map(int, r)) for i, r in enumerate(x)] + [(9999, None, None, None)], "id int, a int, b int, c int").repartition(5)
    keep = [i for i in range(1500) if not ((x >= x[i]).all(1) & (x > x[i]).any(1)).any()]
    assert {r.id for r in C.pareto_frontier(df, ["a", "b", "c"]).collect()} == set(keep)


def test_sites(spark):
    funcs = spark.createDataFrame([("p.Mem.Get", "Get", "p", "*p.Mem"), ("p.Mem.Put", "Put", "p", "*p.Mem"), ("p.Simple.Get", "Get", "p", "p.Simple"), ("q.Run", "Run", "q", None)], "func string, short_name string, pkg string, recv_type string")
    methods = spark.createDataFrame([("p.Mem", "Get"), ("p.Mem", "Put"), ("p.Simple", "Get")], "type string, method string")
    faces = spark.createDataFrame([("Store", "p", "Get"), ("Full", "p", "Get"), ("Full", "p", "Put")], "iface string, pkg string, method string")
    calls = spark.createDataFrame([("q.Run", "p.Mem.Get"), ("q.Run", "p.Mem.Get"), ("generated", "p.Mem.Get")], "src string, dst string")
    name = lambda df: sorted(r.func for r in df.collect())
    assert name(S.callers_of(funcs, calls, "Get")) == ["q.Run"] and name(S.callers_of(funcs, calls, "None")) == []
    assert name(S.implementors_of(funcs, methods, faces, "Full")) == ["p.Mem.Get", "p.Mem.Put"]
    assert rows(S.interface_methods(funcs, methods, faces, "p.Store").select("impl_type", "func")) == {("p.Mem", "p.Mem.Get"), ("p.Simple", "p.Simple.Get")}
    assert name(S.interface_methods(funcs, methods, faces, "Full", "Put")) == ["p.Mem.Put"]
    assert name(S.methods_of(funcs, "Simple")) == ["p.Simple.Get"] and name(S.all_functions_in(funcs, "q")) == ["q.Run"] and S.all_functions_in(funcs).count() == 4


def test_narrowing_with_reasons(spark):
    ins = instr(
        spark,
        dict(func="f", tag="ssa-make-interface", name="a", concrete="T"), dict(func="f", tag="ssa-phi", name="p", operands=["a", "c"]), dict(func="f", tag="ssa-call", name="c", callee="g"),
        dict(func="g", tag="ssa-make-interface", name="x", concrete="U"), dict(func="f", tag="ssa-param", name="q"), dict(func="f", tag="ssa-phi", name="w", operands=["a", "q"]),
        dict(func="f", tag="ssa-store", val="a", struct="S", field="h"), dict(func="g", tag="ssa-field", name="l", struct="S", field="h"), dict(func="g", tag="ssa-call", name="i", recv="I", method="M"),
        dict(func="T.M", tag="ssa-alloc", name="r", type="V"), dict(func="g", tag="ssa-phi", name="z", operands=["z", "x"]), dict(func="g", tag="ssa-call", name="n"),
    )
    returns = spark.createDataFrame([("g", "x"), ("T.M", "r")], "func string, val string")
    impl = spark.createDataFrame([("I", "*T", None)], SCHEMAS["implements"])
    got = {r.node: (r.confidence, r.types, r.reasons) for r in V.narrow_values(*V.narrow_facts(ins, returns, impl)).collect()}
    assert got["f::p"] == ("narrow", ["T", "U"], []) and got["g::l"] == ("narrow", ["T"], []) and got["g::i"] == ("narrow", ["V"], [])
    assert got["f::w"] == ("widened", ["T"], ["parameter"]) and got["g::z"] == ("widened", ["U"], ["cycle"]) and got["g::n"] == ("widened", [], ["no-callee"])


def test_call_graphs_by_value_flow(spark):
    ins = instr(
        spark,
        dict(func="f", tag="ssa-make-interface", name="a", concrete="*T"), dict(func="f", tag="ssa-make-interface", name="b", concrete="U"), dict(func="f", tag="ssa-call", recv="p", method="M", pos="1"),
        dict(func="f", tag="ssa-store", addr="t", field="0", callee="one"), dict(func="f", tag="ssa-store", addr="t", field="1", callee="x"), dict(func="f", tag="ssa-store", addr="t", field="1", callee="y"),
        dict(func="f", tag="ssa-call", addr="t", field="0", pos="2"), dict(func="f", tag="ssa-call", addr="t", field="1", pos="3"),
        dict(func="g", tag="ssa-store", addr="t", field="0", callee="two"), dict(func="g", tag="ssa-escape", addr="t"), dict(func="g", tag="ssa-call", addr="t", field="0", pos="4"),
    )
    copies = spark.createDataFrame([("f::a", "f::p")], "src string, dst string")
    assert rows(V.vta_calls(ins, copies)) == {("f", "T.M", "1")}
    rest = spark.createDataFrame([("f", "z", "2"), ("f", "z", "3"), ("g", "z", "4")], "src string, dst string, pos string")
    assert rows(V.precise_calls(ins, rest)) == {("f", "one", "2"), ("f", "z", "3"), ("g", "z", "4")}


def test_points_to_and_locks(spark):
    ins = instr(
        spark,
        dict(func="f", block=0, ord=0, tag="ssa-alloc", name="m"), dict(func="f", block=0, ord=1, tag="ssa-field-addr", name="l", operands=["m"]),
        dict(func="f", block=0, ord=2, tag="ssa-call", callee="sync.(*Mutex).Lock", operands=["l"], pos="f.go:3"), dict(func="g", block=0, ord=0, tag="ssa-call", method="Lock", recv="q", pos="g.go:1"),
        dict(func="main", block=0, ord=0, tag="ssa-go", callee="f"), dict(func="main", block=0, ord=1, tag="ssa-load", name="d"),
    )
    copies, allocs, unknown = V.points_facts(ins, spark.createDataFrame([("g", "q")], "func string, name string"))
    pts = rows(W.points_to(copies, allocs, unknown))
    assert pts == {("f::m", "f::m"), ("f::l", "f::m"), ("g::q", "?"), ("main::d", "?")}
    assert rows(V.lock_sites(ins).select("func", "value")) == {("f", "f::l"), ("g", "g::q")}
    roots = V.goroutine_roots(ins)
    assert rows(roots) == {("f",), ("main",)}
    calls = spark.createDataFrame([("main", "g"), ("f", "g")], "src string, dst string")
    assert rows(V.roots_of(calls, roots)) == {("main", "main"), ("g", "main"), ("f", "f"), ("g", "f")}
    assert rows(V.call_position(ins, "Lock")) == {("f", "f.go:3"), ("g", "g.go:1")}
    assert [r.ord for r in V.instructions_of(ins, "f").collect()] == [0, 1, 2] and V.instruction_names(ins).count() == 3


def test_canonical_forms(spark):
    def program(a, b, c):
        ins = instr(spark, dict(func="f", block=0, ord=0, tag="ssa-binop", name=a, op="+", x="arg", y="1"), dict(func="f", block=c, ord=0, tag="ssa-binop", name=b, op="*", x=a, y="out"), dict(func="f", block=3 - c, ord=0, tag="ssa-binop", name="w", op="-", x=a, y=a))
        e = spark.createDataFrame([("f", 0, 1), ("f", 0, 2)], "func string, src int, dst int")
        one = lambda n: spark.createDataFrame([("f", 0, n)], "func string, ord int, name string")
        entry = spark.createDataFrame([("f", 0)], "func string, node int")
        return V.canonical(ins, e, entry, one("arg"), one("out")), ins, entry

    got, ins, entry = program("t5", "t9", 1)
    assert rows(got.select("block", "name", "x", "y")) == {(0, "r0", "p0", "1"), (1, "r1", "r0", "fv0"), (2, "r2", "r0", "r0")}
    with pytest.raises(ValueError):
        V.canonical(ins, spark.createDataFrame([("f", 0, 1)], "func string, src int, dst int"), entry, spark.createDataFrame([], "func string, ord int, name string"))
    forms = spark.createDataFrame([("a", 0, 0, "+ x y"), ("b", 0, 3, "+ x y"), ("c", 0, 0, "- x y")], "func string, block int, ord int, form string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "none")], "a string, b string")
    assert rows(V.equivalent(pairs, forms)) == {("a", "b", True), ("a", "c", False), ("a", "none", False)}
    assert rows(V.reachable_blocks(spark.createDataFrame([("f", 0, 1), ("f", 2, 3)], "func string, src int, dst int"), entry)) == {("f", 0), ("f", 1)}


def test_normal_terms():
    n = D.normal_term
    assert n(("&", "x", ("|", "x", "y"))) == "x" and n(("|", "x", ("&", "y", "x"))) == "x"
    assert n(("+", ("+", "a", "b"), "c")) == n(("+", "c", ("+", "b", "a"))) == ("+", "a", "b", "c")
    assert n(("+", "x", 0)) == "x" and n(("*", "x", 0)) == 0 and n(("*", 1, "x")) == "x" and n(("-", "x", 0)) == "x" and n(("&", "x", "x")) == "x"
    assert n(("+", "b", "a"), ("identity",)) == ("+", "b", "a") and n(("-", "b", "a")) == ("-", "b", "a")


def test_malformed_dominance(spark):
    s = spark.createDataFrame([("ok",), ("bad",), ("same",)], "func string")
    ops = spark.createDataFrame([("ok", 0, 0, "a"), ("ok", 1, 0, "b"), ("bad", 0, 0, "a"), ("bad", 1, 0, "b"), ("same", 0, 0, "a"), ("same", 0, 1, "b")], "func string, block int, ord int, op string")
    dom = spark.createDataFrame([("ok", 1, 0), ("ok", 0, 0), ("same", 0, 0)], "func string, node int, dominator int")
    broken = spark.createDataFrame([("bad",), ("same",)], "func string")
    assert rows(B.ordered(s, ops, "a", "b", dom, broken)) == {("ok", "a-dominates-b"), ("bad", "malformed-ssa"), ("same", "a-dominates-b")}
    assert rows(B.dominates_call(s.where("func <> 'same'"), ops, dom, "a", "b", broken)) == {("ok", "dominates-all"), ("bad", "malformed-ssa")}


def test_beliefs_that_fail_while_they_run(spark):
    site = lambda *c: spark.createDataFrame([(i, x) for i, x in enumerate(c)], "site int, category string")
    r = B.Beliefs(spark)
    r.define(B.Belief("good", lambda: site("a", "a", None), source="s1"))
    r.define(B.Belief("fails", lambda: site("a").select("site", F.raise_error(F.lit("no")).cast("string").alias("category"))))
    assert {x.name: x.status for x in r.run().collect()} == {"good": "strong", "fails": "error"}
    assert [x.site for x in r.sites_from("good", "deviation").collect()] == [2]  # no category is another one
    assert r.activate([{"name": "new", "source": "s2", "threshold": [2, 3, 1]}, {"name": "good", "source": "s1"}], lambda s: lambda: site(s, s)) == ["new"]
    assert {x.name: x.status for x in r.run().collect()}["new"] == "strong"
    known = spark.createDataFrame([("s1",), ("",)], "source string")
    assert {x.name for x in B.suppress_known(r.run(), known).collect()} == {"fails", "new"}


def test_receiver_facts(spark):
    funcs = spark.createDataFrame([("m", "*T", "Get"), ("s", "T", "Set"), ("f", None, "Run")], "func string, recv_type string, short_name string")
    acc = spark.createDataFrame([("m", "T", "a", "read"), ("m", "U", "b", "write"), ("s", "T", "a", "write")], "func string, struct string, field string, mode string")
    par = spark.createDataFrame([("m",), ("s",), ("f",)], "func string")
    face = spark.createDataFrame([("T", "Get")], "type string, method string")
    assert rows(B.receiver_asymmetry(B.receiver_facts(funcs, acc, par, face, par.limit(0)))) == {("m", "interface-method"), ("s", "mutation"), ("f", "no-receiver")}


def test_tree_diff_of_inner_nodes(spark):
    kinds = "tree int, path string, field string, vtype string, value string, tag string"
    tree = lambda n, call, extra: [(n, "f", "", "node", "func", None), (n, "f/name", "name", "string", "g", "func"), (n, "f/body", "body", "list", None, "func"), (n, "f/body/0", "", "node", call, None), (n, "f/body/0/type", "type", "string", "A" if call == "call" else "B", call)] + extra
    more = [(2, "f/body/1", "", "node", "ret", None), (2, "f/body/1/value", "value", "int", "1", "ret")]
    df = spark.createDataFrame(tree(1, "call", []) + tree(2, "go", more) + tree(3, "call", []), kinds)
    d = T.tree_diff(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), df, T.classify_ast)
    got = {(r.b, r.path): r.category for r in d.collect()}
    assert got == {(2, "f"): "shared", (2, "f/name"): "shared", (2, "f/body/0"): "structural", (2, "f/body/1"): "extra-element", (3, "f"): "shared", (3, "f/name"): "shared", (3, "f/body/0"): "shared", (3, "f/body/0/type"): "shared"}
    one = spark.createDataFrame([(f, p, t) for f, p, t in (("name", "type/name", None), ("name", "a/name", "ssa-func"), ("name", "a/name", "ssa-call"), ("func", "a/func", None), ("idom", "a/idom", None))], "field string, path string, tag string")
    c = [F.col(x) for x in ("field", "path", "tag")]
    assert [tuple(r) for r in one.select(T.classify_ast(*c), T.classify_ssa(*c)).collect()] == [("type-name", "register"), ("identifier", "identifier"), ("identifier", "register"), ("identifier", "call-target"), ("identifier", "structural")]


def test_recommendations(spark):
    e = spark.createDataFrame([("Initialize", "SetupConfig"), ("Initialize", "SetupLogger")], "src string, dst string")
    p = spark.createDataFrame([("Initialize", "SetupConfig"), ("SetupConfig", "SetupLogger"), ("SetupConfig", "Initialize")], "a string, b string")
    assert rows(C.creates_cycle(p, e)) == {("Initialize", "SetupConfig", True), ("SetupConfig", "SetupLogger", False), ("SetupConfig", "Initialize", True)}
    ctx = spark.createDataFrame([("Read", "io"), ("Write", "io"), ("Parse", "ast"), ("Check", "ast"), ("Bridge", "io"), ("Bridge", "ast")], "object string, attribute string")
    none = spark.createDataFrame([], "func string, name string")
    v = C.single_cluster(ctx, none).first()
    assert v.verdict in ("SPLIT", "COHESIVE") and v.functions == 5 and (v.verdict == "SPLIT") == (v.confidence in ("HIGH", "MEDIUM"))
    pos = spark.createDataFrame([("Read", "a.go:1")], "func string, pos string")
    assert C.split_findings(C.find_split(ctx), pos).count() == 4
    assert C.pair_findings(p.withColumn("tier", F.lit("proven")).withColumn("similarity", F.lit(1.0)), pos).count() == 6
    loads = spark.createDataFrame([("f", "l", "A")], "func string, node string, struct string")
    stores = spark.createDataFrame([("f", "s", "B"), ("f", "o", "A")], "func string, node string, struct string")
    du = spark.createDataFrame([("f", "l", "m"), ("f", "m", "s"), ("f", "m", "o")], "func string, src string, dst string")
    cross = C.cross_flows(loads, stores, du)
    assert rows(cross) == {("f", "A", "B")}
    assert rows(C.without_cross_flow(spark.createDataFrame([("f",), ("g",)], "func string"), cross)) == {("f", False), ("g", True)}


def test_dispatch_details(spark):
    s = spark.createDataFrame([(1, 2), (2, 1)], "site int, n int")
    e = spark.createDataFrame([(1, "p.Store", "Get", None), (1, "p.Store", "Get", True), (2, "p.small", "Put", False)], "site int, iface string, method string, caller_synthetic boolean")
    for scope, flag in ((["main"], False), (["main", "reflect.ValueOf"], True)):
        got = rows(W.dispatch_details(s, e, ["site"], spark.createDataFrame([(x,) for x in scope], "name string")).select("site", "iface_exported", "synthetic_caller", "reflection_in_scope"))
        assert got == {(1, "true", True, flag), (2, "false", False, flag)}


def test_analyzers_and_views(spark):
    c = FactCatalog(spark, tables={"instr": instr(spark, dict(func="f", tag="ssa-call", callee="f", pos="1"), dict(func="f", tag="ssa-call", callee="g", pos="2")), "func": spark.createDataFrame([("p.lost", None, "p", None, "3", None, False, None, 0, 0, 1), ("p.Kept", None, "p", None, "4", None, False, None, 0, 0, 1)], SCHEMAS["func"])})
    assert rows(A.analyze(c).select("analyzer", "pos")) == {("selfcall", "1"), ("uncalled", "3")}
    assert [n for n, _ in A.analyzers()] == ["lostblock", "selfcall", "uncalled"] and A.analyze(c, "selfcall").count() == 1
    with pytest.raises(KeyError):
        A.analyze(c, "unknown")
    c.views("facts_")
    assert spark.sql("SELECT count(*) FROM facts_instr WHERE callee = 'g'").first()[0] == 1
