import pytest
from pyspark.sql import functions as F

from factloom.operators import concepts as C


def ctx(spark, **objects):
    return spark.createDataFrame([(o, a) for o, attrs in objects.items() for a in attrs], "object string, attribute string")


def one(df):
    return sorted(r[0] for r in df.collect())


def lattice(df):
    return {(tuple(r.intent), tuple(r.extent)) for r in C.concepts(df).collect()}


def test_derivations(spark):
    c = ctx(spark, F1=["A.x", "A.y", "B.z"], F2=["A.x", "A.y", "B.z"], F3=["A.x", "A.y"])
    objs = lambda *o: spark.createDataFrame([(x,) for x in o], "object string")
    attrs = lambda *a: spark.createDataFrame([(x,) for x in a], "attribute string")
    assert one(C.intent(c, objs("F1", "F2", "F3"))) == ["A.x", "A.y"]
    assert one(C.intent(c, objs())) == ["A.x", "A.y", "B.z"]
    assert one(C.extent(c, attrs("A.x", "A.y", "B.z"))) == ["F1", "F2"]
    assert one(C.extent(c, attrs())) == ["F1", "F2", "F3"]
    assert len(lattice(c)) == 2
    cross = C.cross_boundary(C.concepts(c))
    assert [r.extent for r in cross.collect()] == [["F1", "F2"]]
    assert C.cross_boundary(C.concepts(c), min_extent=3).count() == 0
    r = C.boundary_report(cross).first()
    assert (r.types, r.fields, r.functions, r.extent_size) == ("A+B", "A{x,y};B{z}", "F1,F2", 2)
    assert C.annotated_report(cross).first().summary == "A+B"


def test_top_and_bottom(spark):
    got = lattice(ctx(spark, F1=["A.x", "A.y"], F2=["A.x", "A.y"], F3=["B.z", "B.w"]))
    assert got == {((), ("F1", "F2", "F3")), (("A.x", "A.y"), ("F1", "F2")), (("B.w", "B.z"), ("F3",)), (("A.x", "A.y", "B.w", "B.z"), ())}


def test_mask_boundary(spark):
    assert len(lattice(ctx(spark, o=[f"a{i:02}" for i in range(63)]))) == 1
    with pytest.raises(ValueError):
        C.concepts(ctx(spark, o=[f"a{i:02}" for i in range(64)]))


def test_relationship(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "b"]), (["a"], ["a"]), (["a"], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(C.relationship("x", "y")).collect()] == ["subconcept", "superconcept", "equal", "incomparable"]


def test_field_context(spark):
    acc = spark.createDataFrame([("f", "S", "a", "write"), ("f", "S", "b", "read"), ("f", "T", "c", "write"), ("g", "S", "a", "write")], "func string, struct string, field string, mode string")
    assert one(C.field_context(acc).select("attribute")) == ["S.a", "S.a", "T.c"]
    assert one(C.field_context(acc, cross_type_only=True).select("object")) == ["f", "f"]
    assert one(C.field_context(acc, "read-write").where("object = 'f'").select("attribute")) == ["S.a:w", "S.b:r", "T.c:w"]
    with pytest.raises(ValueError):
        C.field_context(acc, "other")


def test_propagation(spark):
    w = spark.createDataFrame([("SetupConfig", "Config.Host"), ("SetupLogger", "Logger.Level")], "func string, attribute string")
    e = spark.createDataFrame([("Initialize", "SetupConfig"), ("Initialize", "SetupLogger"), ("SetupLogger", "SetupLogger")], "src string, dst string")
    assert one(C.propagate_writes(w, e).where("func = 'Initialize'").select("attribute")) == ["Config.Host", "Logger.Level"]


def test_split(spark):
    c = ctx(spark, F1=["A", "C"], F2=["A", "C"], F3=["B", "D"], F4=["B", "D"], F5=["A", "B"])
    assert {r.object: r.side for r in C.find_split(c).collect()} == {"F1": "a", "F2": "a", "F3": "b", "F4": "b", "F5": "cut"}
    refs = spark.createDataFrame([("F1", "F3")], "func string, name string")
    r = C.recommend_split(c, refs).first()
    assert (r.group_a, r.group_b, r.cut, r.cut_ratio, r.acyclic, r.confidence) == (2, 2, 1, 0.2, True, "MEDIUM")
    both = spark.createDataFrame([("F1", "F3"), ("F3", "F1")], "func string, name string")
    assert C.recommend_split(c, both).first().confidence == "LOW"
    assert C.recommend_split(ctx(spark, F1=["A"], F2=["A"], F3=["A"]), refs).first().confidence == "NONE"
    assert C.recommend_split(ctx(spark, F1=["A"], F2=[f"a{i}" for i in range(31)]), refs).first().confidence == "NONE"
    assert C.recommend_split(ctx(spark, F1=["A"]), refs).first().confidence == "NONE"


def test_idf(spark):
    s = spark.createDataFrame([("F1", "io"), ("F1", "fmt"), ("F2", "io"), ("F2", "strings"), ("F3", "io")], "func string, ref_pkg string")
    w = C.idf(s, s.select("func"))
    got = {r.ref_pkg: r.idf for r in w.collect()}
    assert got["io"] == 0 and got["fmt"] == pytest.approx(1.0986123)
    assert one(C.filter_noise(s, w).select("ref_pkg")) == ["fmt", "strings"]


def test_pareto(spark):
    rows = spark.createDataFrame([("r1", 3, 3), ("r2", 1, 1), ("r3", 4, 1), ("r4", None, 3)], "k string, a int, b int")
    assert one(C.pareto_frontier(rows, ["a", "b"]).select("k")) == ["r1", "r3"]
    assert {r.k: r.dominator for r in C.pareto_dominated(rows, "k", ["a", "b"]).collect()} == {"r2": "r1", "r4": "r1"}
    same = spark.createDataFrame([("x", 1), ("y", 1)], "k string, a int")
    assert C.pareto_frontier(same, ["a"]).count() == 2


def test_candidates(spark):
    c = ctx(spark, ProcessRequest=["A.x", "A.y", "B.z", "B.w"], ConfigOnly=["A.x"], MetricsOnly=["B.z"])
    assert one(C.split_candidates(C.concepts(c)).select("func")) == ["ProcessRequest"]
    m = ctx(spark, Reset=["S.T", "S.E"], Expire=["S.T", "S.E"], Other=["X.a"])
    got = {tuple(r.intent): r.intent_overlap for r in C.merge_candidates(C.concepts(m), m).collect()}
    assert got == {("S.E", "S.T"): 1.0}
    assert {tuple(r.intent): tuple(r.narrow) for r in C.extract_candidates(C.concepts(c)).collect()}[("A.x",)] == ("A.x", "A.y", "B.w", "B.z")


def test_duplicates(spark):
    k = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "c")], "item int, key string")
    assert [tuple(r) for r in C.duplicate_pairs(k, k).collect()] == [(1, 2)]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [round(r[0], 4) for r in df.select(C.jaccard("x", "y")).collect()] == [0.3333, 0.0]
    assert [r[0] for r in df.select(C.tier(F.size("x") == 0, C.jaccard("x", "y"), 0.3).alias("t")).select(C.verdict("t")).collect()] == ["likely-duplicate", "duplicate"]
