import pytest
from pyspark.sql import functions as F

from factloom.functions import lists as L
from factloom.operators import beliefs as B
from factloom.operators import kernels as K
from factloom.plans import pipelines as P
from factloom.sources.catalog import FactCatalog
from factloom.streaming.beliefs import windowed_votes


def test_lists(spark):
    df = spark.createDataFrame([([3, 1, 3], "a.b.C"), ([], "x"), (None, None)], "a array<int>, s string")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(L.take("a", 2)) == [[3, 1], [], None] and one(L.take("a", -1)) == [[], [], None]
    assert one(L.drop("a", 1)) == [[1, 3], [], None]
    assert one(L.unique("a")) == [[3, 1], [], None] and one(L.member("a", 1)) == [True, False, False]
    assert [[tuple(p) for p in x or []] for x in one(L.ordered_pairs("a"))] == [[(3, 1), (3, 3), (1, 3)], [], []]
    assert one(L.filter_map("a", lambda x: F.when(x > 1, x * 2))) == [[6, 6], [], None]
    assert one(L.flat_map("a", lambda x: F.array(x, x)))[0] == [3, 3, 1, 1, 3, 3]
    assert one(L.index_of("s", "b")) == [2, None, None] and one(L.short_name("s")) == ["C", "x", None]


def test_trees_of_nodes(spark):
    rows = [("t", 0, ["f"], "file"), ("t", 1, ["f", "a"], "call"), ("t", 2, ["f", "a", "x"], "arg"), ("t", 3, ["f", "b"], "call"), ("u", 1, ["f"], "q")]
    df = spark.createDataFrame(rows, "tree string, id long, path array<string>, value string")
    assert [r.id for r in L.walk(df.where("tree = 't'"), 1).collect()] == [1, 2]
    out = L.transform_nodes(df, F.col("id") == 1, F.lit("new")).collect()
    assert {(r.tree, r.id): r.value for r in out} == {("t", 0): "file", ("t", 1): "new", ("t", 3): "call", ("u", 1): "new"}


INS = "func string, block int, ord int, name string, op string, x string, y string"


def test_constants_and_signs(spark):
    ins = spark.createDataFrame([("f", 0, 0, "a", "+", "2:int", "3:int"), ("f", 0, 1, "b", "*", "a", "-4:int"), ("f", 1, 0, "c", "+", "a", "p"), ("f", 1, 1, "d", "/", "a", "0:int"), ("f", 1, 2, "e", "/", "b", "3:int")], INS)
    blocks = spark.createDataFrame([("f", 0, 1)], "func string, src int, dst int")
    assert {r.name: r.value for r in K.constants(ins, blocks).collect()} == {"a": "5", "b": "-20", "c": "top", "d": "top", "e": "-6"}
    assert {r.name: r.sign for r in K.signs(ins, blocks).collect()} == {"a": "pos", "b": "neg", "c": "top", "d": "top", "e": "top"}


def test_intervals_end_on_loops(spark):
    ins = spark.createDataFrame([("f", 0, 0, "i0", "+", "0:int", "0:int"), ("f", 1, 0, "i", "phi", "i0", "i1"), ("f", 1, 1, "i1", "+", "i", "1:int")], INS)
    blocks = spark.createDataFrame([("f", 0, 1), ("f", 1, 1)], "func string, src int, dst int")
    got = {r.name: (r.lo, r.hi) for r in K.intervals(ins, blocks).collect()}
    assert got["i0"] == (0, 0) and got["i"][0] == 0 and got["i1"] == (1, float("inf"))


@pytest.fixture(scope="module")
def catalog(spark):
    acc = [(f, "p", f"{f}.go:1", s, "p", x, None, "write") for f in ("UpdateBoth", "Invalidate", "Rebuild") for s, x in (("Cache", "Entries"), ("Cache", "TTL"), ("Index", "Keys"), ("Index", "Version"))]
    acc += [("CacheOnly", "p", None, "Cache", "p", "TTL", None, "write"), ("IndexOnly", "p", None, "Index", "p", "Version", None, "write")]
    refs = [("Read", "io"), ("Write", "io"), ("Parse", "go/ast"), ("Check", "go/ast"), ("Bridge", "io"), ("Bridge", "go/ast")]
    nodes = [(t, i, None, ["body", str(i)], i, "call", "value", "int", v) for t, vs in (("Read", "12"), ("Write", "12"), ("Parse", "34"), ("Check", "99")) for i, v in enumerate(vs)]
    return FactCatalog(
        spark,
        tables={
            "field_access": spark.createDataFrame(acc, "func string, pkg string, pos string, struct string, struct_pkg string, field string, recv string, mode string"),
            "func_ref": spark.createDataFrame([(f, "p", None, r, "o") for f, r in refs], "func string, pkg string, pos string, ref_pkg string, object string"),
            "func": spark.createDataFrame([(f,) for f in {f for f, _ in refs}], "func string"),
            "node": spark.createDataFrame(nodes, "tree string, id long, parent long, path array<string>, ord int, tag string, field string, vtype string, value string"),
            "cg_edge": spark.createDataFrame([("cha", "main", "Read"), ("cha", "main", "Write")], "algo string, caller string, callee string"),
        },
    )


def test_false_boundaries(catalog):
    out = P.false_boundaries(catalog)
    got = {r.finding["value"]: (r.finding["where"], r.finding["why"]["data"]["types"]) for r in out["result"].collect()}
    assert got == {f: (f"{f}.go:1", "Cache+Index") for f in ("UpdateBoth", "Invalidate", "Rebuild")} and out["version"]


def test_recommendations(catalog):
    r = P.recommend_split(catalog)["result"].first()
    assert (r.functions, r.group_a, r.group_b, r.cut, r.confidence) == (5, 2, 2, 1, "MEDIUM")
    b = P.recommend_boundaries(catalog)["result"]
    assert set(b) == {"split", "merge", "extract"} and all(x.count() > 0 for x in b.values())


def test_duplicates(catalog):
    got = {(r.a, r.b): (r.tier, r.verdict, r.new_edges) for r in P.duplicates(catalog)["result"].collect()}
    assert got["Read", "Write"] == ("proven", "duplicate", 1) and got["Check", "Parse"][1] == "distinct"


def test_discovery(spark):
    r = B.Beliefs(spark)
    for n in ("old", "new"):
        r.define(B.Belief(n, lambda: spark.createDataFrame([(i, "a") for i in range(4)], "site int, category string")))
    assert P.check_beliefs(r)["result"].count() == 2
    out = P.discover_beliefs(r, spark.createDataFrame([("old",)], "name string"))
    assert (out["raw"], out["filtered"]) == (2, 1) and [x.name for x in out["result"].collect()] == ["new"]


def test_votes_on_a_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS c UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'a' UNION ALL SELECT timestamp'2024-01-05 02:00:00', 'b'").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, c string").parquet(src)
    q = windowed_votes(stream, F.col("c")).writeStream.outputMode("complete").format("memory").queryName("votes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.category, r.cnt) for r in spark.table("votes").collect()) == [("a", 2), ("b", 1)]
