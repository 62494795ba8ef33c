import pytest
from pyspark.sql import functions as F

from factloom.operators import beliefs as B


def sites(spark, *cats):
    return spark.createDataFrame(list(enumerate(cats)), "site int, category string")


def cats(df):
    return {r[0]: r[1] for r in df.collect()}


def ops(spark, **funcs):
    rows = [(f, i, op, bool(d)) for f, seq in funcs.items() for i, (op, d) in enumerate((x if isinstance(x, tuple) else (x, False)) for x in seq)]
    return spark.createDataFrame(rows, "func string, ord int, op string, is_defer boolean")


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "func string")


def test_majority_and_ties(spark):
    r = B.verdict(B.votes(sites(spark, "a", "a", "b", "a"))).first()
    assert (r.pattern, r.adherent, r.total, r.ratio, r.status) == ("a", 3, 4, 0.75, "strong")
    # of equals the category that appears latest for the first time
    assert B.verdict(B.votes(sites(spark, "a", "b", "b", "a"))).first().pattern == "b"
    assert B.verdict(B.votes(sites(spark, "a", "b")), (9, 10), 3).first().status == "weak"
    assert B.verdict(B.votes(sites(spark, "a", "b").limit(0))).count() == 0


def test_pairing(spark):
    o = ops(spark, S1=["Lock", ("Unlock", True)], S2=["Lock", ("Unlock", True)], S3=["Lock", "Unlock"], Bad=["Lock"])
    got = cats(B.paired_with(names(spark, "S1", "S2", "S3", "Bad"), o, "Unlock"))
    assert got == {"S1": "paired-defer", "S2": "paired-defer", "S3": "paired-call", "Bad": "unpaired"}


def test_ordering(spark):
    o = ops(spark, A=["V", "P"], R=["P", "V"], M=["V"])
    assert cats(B.ordered(names(spark, "A", "R", "M"), o, "V", "P")) == {"A": "a-dominates-b", "R": "b-dominates-a", "M": "missing"}
    blocks = spark.createDataFrame([("A", 0, "V", 0), ("A", 0, "P", 1), ("X", 0, "V", 1), ("X", 0, "P", 2)], "func string, ord int, op string, block int")
    dom = spark.createDataFrame([("A", 1, 0), ("X", 1, 0), ("X", 2, 0)], "func string, node int, dominator int")
    assert cats(B.ordered(names(spark, "A", "X"), blocks, "V", "P", dom)) == {"A": "a-dominates-b", "X": "unordered"}


def test_dominates_call(spark):
    o = spark.createDataFrame([("all", "c", 0), ("all", "a", 1), ("all", "a", 2), ("part", "c", 1), ("part", "a", 1), ("part", "a", 2), ("none", "c", 2), ("none", "a", 1), ("miss", "a", 0)], "func string, op string, block int")
    dom = spark.createDataFrame([(f, n, d) for f in ("all", "part", "none", "miss") for n in range(3) for d in {0, n}], "func string, node int, dominator int")
    got = cats(B.dominates_call(names(spark, "all", "part", "none", "miss"), o, dom, "c", "a"))
    assert got == {"all": "dominates-all", "part": "partial", "none": "none", "miss": "missing"}


def test_flows_to_all(spark):
    starts = spark.createDataFrame([("f", "a"), ("g", "a"), ("h", "a")], "func string, node string")
    ends = spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "x"), ("g", "y"), ("h", "x")], "func string, node string")
    edges = spark.createDataFrame([("f", "a", "m"), ("f", "m", "x"), ("f", "m", "y"), ("g", "a", "x")], "func string, src string, dst string")
    got = cats(B.flows_to_all(names(spark, "f", "g", "h", "i"), starts, ends, edges))
    assert got == {"f": "flows-all", "g": "partial", "h": "none", "i": "missing"}


def test_calls_and_fields(spark):
    o = ops(spark, one=["apply"], two=["apply", "apply"], no=["x"])
    s = names(spark, "one", "two", "no")
    assert cats(B.single_call_site(s, o, "apply")) == {"one": "single", "two": "multiple", "no": "missing"}
    assert cats(B.contains_call(s, o, "apply")) == {"one": "present", "two": "present", "no": "absent"}
    acc = spark.createDataFrame([("R", "C", f, "write") for f in ("Host", "Port", "Timeout")] + [("S", "C", "Host", "write"), ("Q", "C", "Host", "read")], "func string, struct string, field string, mode string")
    assert cats(B.co_mutated(names(spark, "R", "S", "Q"), acc, "Host", "Port", "Timeout")) == {"R": "co-mutated", "S": "partial", "Q": "missing"}
    assert [r[0] for r in B.stores_to_fields(acc, "C", "Host", "Port").collect()] == ["R"]


def test_reach_and_checks(spark):
    e = spark.createDataFrame([("Direct", "Target"), ("OneHop", "Direct"), ("Bad", "helper")], "src string, dst string")
    t = spark.createDataFrame([("Target",)], "node string")
    assert cats(B.reaches_call(names(spark, "Direct", "OneHop", "Bad", "Target", "Else"), e, t)) == {"Direct": "reaches", "OneHop": "reaches", "Bad": "unreached", "Target": "unreached", "Else": "unresolved"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    seeds = spark.createDataFrame([("near", 5), ("far", 0), ("none", None)], "site string, node int")
    assert cats(B.checked_before_use(seeds, chain, spark.createDataFrame([(9,)], "node int"), 5)) == {"near": "guarded", "far": "unguarded", "none": "missing"}


def test_receiver_asymmetry(spark):
    base = dict(found=True, is_method=True, recv_writes=0, n_params=1, recv_reads=1, in_interface=False, forwards=False)
    cases = {"candidate": {}, "missing": {"found": False}, "no-receiver": {"is_method": False}, "mutation": {"recv_writes": 1}, "accessor": {"n_params": 0}, "unused-recv": {"recv_reads": 0}, "multi-read": {"recv_reads": 2}, "interface-method": {"in_interface": True}, "forwarder": {"forwards": True}}
    df = spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], ["func", *base])
    assert all(k == v for k, v in cats(B.receiver_asymmetry(df)).items())


def test_registry(spark):
    r = B.Beliefs(spark)
    r.define(B.Belief("good", lambda: sites(spark, "a", "a", "a", "b"), source="x"))
    r.define(B.Belief("empty", lambda: sites(spark, "a").limit(0)))
    r.define(B.Belief("broken", lambda: sites(spark, "a").select("nothing")))
    out = {x.name: x.status for x in r.run().collect()}
    assert out == {"good": "strong", "empty": "no-sites", "broken": "error"}
    assert [x.site for x in r.sites_from("good", "deviation").collect()] == [3]
    with pytest.raises(KeyError):
        r.sites_from("unknown")
    with r.scope():
        r.reset()
        assert not r.beliefs
    assert len(r.beliefs) == 3
    assert [x.name for x in r.emit(r.run()).collect()] == ["good"]


def test_combinators(spark):
    df = spark.createDataFrame([("pkg.Run", ["int", "*x.T"], "*pkg.S"), ("pkg.Go", None, None)], "func string, types array<string>, recv string")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(B.has_params("types", "x.T", "int")) == [True, False]
    assert one(B.has_receiver("recv", "pkg.S")) == [True, False]
    assert one(B.all_of()) == [True, True] and one(B.any_of()) == [False, False]
    assert one(B.none_of(B.name_contains("func", "Run"))) == [False, True]


def test_conventions(spark):
    rows = [("T", f"m{i}", "Close") for i in range(4)] + [("T", "m4", "x"), ("U", "n", "Close")]
    got = B.conventions(spark.createDataFrame(rows, "type string, member string, callee string")).collect()
    assert [tuple(r) for r in got] == [("T", "m4", "Close")]


def test_windowed_votes(spark):
    from factloom.streaming.beliefs import windowed_votes

    e = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 01:00:00", "b")], "t string, c string").select(F.to_timestamp("t").alias("ts"), "c")
    assert sorted((r.category, r.cnt) for r in windowed_votes(e, F.col("c")).collect()) == [("a", 2), ("b", 1)]
