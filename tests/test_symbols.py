import pytest
from pyspark.sql import functions as F

from factloom.operators import domains as D
from factloom.operators import findings as N
from factloom.operators import trees as T
from factloom.sources import catalog as K


def test_boolean_terms():
    assert D.simplify(("and", "x", ("or", "x", "y"))) == "x"
    assert D.simplify(("not", ("not", "x"))) == "x"
    assert D.simplify(("and", "x", "x")) == "x"
    assert D.equivalent(("and", "x", "y"), ("and", "y", "x")) and not D.equivalent(("and", "x", "y"), ("or", "x", "y"))
    assert D.simplify(("or", "x", ("not", "x"))) is True and D.simplify(("and", "x", ("not", "x"))) is False
    assert D.equivalent(("not", ("and", "a", "b")), ("or", ("not", "a"), ("not", "b")))
    assert D.Selector("none-of", ("Lock",)).term() == ("not", "Lock")
    with pytest.raises(ValueError):
        D.Selector("all-of", ()).term()
    assert D.condition("!(a && b) || c == 1") == ("or", ("not", ("and", "a", "b")), "c == 1")


def test_domains(spark):
    df = spark.createDataFrame([(-1, 2), (0, 5), (3, None)], "a int, b int")
    s = [tuple(r) for r in df.select(D.sign(F.col("a")), D.sign_op("mul", D.sign(F.col("a")), D.sign(F.col("b"))), D.sign_op("sub", D.sign(F.col("a")), D.sign(F.col("b")))).collect()]
    assert s == [("neg", "neg", "neg"), ("zero", "zero", "neg"), ("pos", "bottom", "bottom")]
    x = D.interval_op("mul", D.interval(F.lit(-2), F.lit(3)), D.interval(F.lit(4), F.lit(5)))
    r = spark.range(1).select(x["lo"], x["hi"], D.widen(D.interval(F.lit(0), F.lit(1)), D.interval(F.lit(0), F.lit(2)))["hi"]).first()
    assert tuple(r) == (-10.0, 15.0, float("inf"))
    f = spark.createDataFrame([("+", "3:int", "4:int8"), ("/", "-7:int", "2:int"), ("%", "-7:int", "2:int"), ("/", "1:int", "0:int"), ("+", "3:string", "1:int")], "op string, x string, y string")
    assert [r[0] for r in f.select(D.fold(F.col("op"), D.constant(F.col("x")), D.constant(F.col("y")))).collect()] == [7, -3, -1, None, None]


def test_normalize(spark):
    cases = [("+", "x", "0", True), ("*", "x", "0", True), ("&", "x", "x", True), ("+", "b", "a", False), ("-", "b", "a", True), ("+", "x", "0", False)]
    df = spark.createDataFrame(cases, "op string, x string, y string, i boolean")
    n = D.normalize(*[F.col(c) for c in ("op", "x", "y", "i")])
    assert [tuple(r) for r in df.select(n["op"], n["x"], n["y"]).collect()] == [("copy", "x", None), ("const", "0", None), ("copy", "x", None), ("+", "a", "b"), ("-", "b", "a"), ("+", "0", "x")]


def test_solver_widens():
    inf = float("inf")
    out = D.solve({0: [1], 1: [1, 2], 2: []}, lambda b, s: s if s is None or b != 1 else (s[0], s[1] + 1), lambda a, b: b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1])), None, (0, 0), widening=lambda o, n: n if o is None or n is None else (o[0] if n[0] >= o[0] else -inf, o[1] if n[1] <= o[1] else inf))
    assert out[2] == ((0, inf), (0, inf))


def test_tree_diff(spark):
    leaves = spark.createDataFrame(
        [(1, "name", "name", "string", "f"), (1, "p/0", "type", "string", "Int"), (1, "p/1", "type", "string", "ListInt"), (1, "lit", "value", "int", "1"), (1, "old", "x", "string", "q"),
         (2, "name", "name", "string", "f"), (2, "p/0", "type", "string", "Str"), (2, "p/1", "type", "string", "ListStr"), (2, "lit", "value", "int", "2"), (2, "p/2", "type", "string", "Z")],
        "tree int, path string, field string, vtype string, value string",
    )
    d = T.tree_diff(spark.createDataFrame([(1, 2)], "a int, b int"), leaves)
    assert {r.path: r.category for r in d.collect()} == {"name": "shared", "p/0": "type-name", "p/1": "type-name", "lit": "literal-value", "old": "missing-field", "p/2": "extra-element"}
    c = T.collapse(d)
    assert {r.path: r.category for r in c.collect()}["p/1"] == "derived-type"
    s = T.score(c).first()
    assert (s.shared, s.diff_count, s.derived, s.type_params, s.value_params, s.cost) == (1, 5, 1, 1, 1, 102)
    assert not T.unifiable(T.score(c)).first().unifiable
    t = {r.path: r.text for r in T.template(c).collect()}
    assert t["p/0"] == "?T0" and t["name"] == "f"


def test_findings(spark):
    df = spark.createDataFrame([("v", "f.go:1:2", 0.5), ("w", None, None)], "v string, pos string, s double")
    f = N.finding(F.col("v"), F.col("pos"), "tag", {"b": F.lit(2), "a": F.lit("x")}, F.col("s"))
    assert [r[0] for r in df.select(N.render(f)).collect()] == ["f.go:1:2 — tag (a=x, b=2) [0.50]", "<unlocated> — tag (a=x, b=2)"]


def test_catalog(spark, tmp_path):
    ins = spark.createDataFrame([("f", "ssa-field-addr", "t0", "S", "a", None), ("f", "ssa-field-addr", "t1", "S", "b", None), ("f", "ssa-store", None, None, None, "t0")], "func string, tag string, name string, struct string, field string, addr string")
    assert {(r.field, r.mode) for r in K.field_index(ins).collect()} == {("a", "write"), ("b", "read")}
    m = spark.createDataFrame([("Mem", x) for x in ("Get", "Set")] + [("Not", "Get")], "type string, method string")
    i = spark.createDataFrame([("Store", "p", "Get"), ("Store", "p", "Set"), ("Empty", "p", None)], "iface string, pkg string, method string")
    assert [r[0] for r in K.implementors(m, i, "p.Store").collect()] == ["Mem"]
    for bad in ("Empty", "Nope"):
        with pytest.raises(ValueError):
            K.implementors(m, i, bad)
    c = K.FactCatalog(spark, tables={"cg_edge": spark.createDataFrame([(1, "cha", "a", "b")], "edge_id long, algo string, caller string, callee string")})
    assert c.callgraph("rta", "cha").count() == 1
    c.save(str(tmp_path))
    assert K.FactCatalog(spark, str(tmp_path)).table("cg_edge").count() == 1
    with pytest.raises(KeyError):
        c.table("nothing")


def test_rta(spark):
    static = spark.createDataFrame([("main", "f")], "src string, dst string")
    cha = spark.createDataFrame([("f", "A.M"), ("f", "B.M")], "src string, dst string")
    creates = spark.createDataFrame([("f", "A"), ("dead", "B")], "func string, type string")
    got = K.rta_calls(static, cha, creates, spark.createDataFrame([("main",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("main", "f"), ("f", "A.M")}
