"""Majority-vote consistency mining: selectors, checkers, votes, deviations."""

from __future__ import annotations

import json
import pathlib
import sys
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed, grow, placed
from . import paths


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, map(_sure, ps), F.lit(True))


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, map(_sure, ps), F.lit(False))


def none_of(*ps: Column) -> Column:
    return ~any_of(*ps)


def _some_contains(types: str, part: str) -> Column:
    return F.exists(types, lambda p: p.contains(part))


def has_params(types: str, *wanted: str) -> Column:
    """Each wanted string is part of some parameter type (``types`` is an array)."""
    return all_of(*[_some_contains(types, w) for w in wanted])


def has_receiver(column: str, part: str) -> Column:
    return _sure(F.regexp_replace(column, r"^\*", "").contains(part))


def name_contains(column: str, part: str) -> Column:
    return _sure(F.col(column).contains(part))


def votes(sites: DataFrame, site: str = "site", category: str = "category") -> DataFrame:
    """(category, cnt, first_site) of classified sites."""
    return sites.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("cnt"), F.min(site).alias("first_site"))


def verdict(v: DataFrame, adherence: tuple[int, int] = (1, 2), min_sites: int = 3) -> DataFrame:
    """(pattern, adherent, total, ratio, status) of votes: one row, none without sites.

    The most frequent category wins, among equals the one that appears latest for the first time.
    The bound on the ratio is a fraction, compared in integers.
    """
    w = Window.partitionBy(F.lit(0))  # a row for each category
    r = v.withColumn("total", F.sum("cnt").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("cnt"), F.desc("first_site"))))
    num, den = adherence
    strong = (F.col("cnt") * den >= F.col("total") * num) & (F.col("total") >= min_sites)
    return r.where("rn = 1").select(F.col("category").alias("pattern"), F.col("cnt").alias("adherent"), "total", F.round(F.col("cnt").cast("double") / F.col("total").cast("double"), 6).alias("ratio"), F.when(strong, "strong").otherwise("weak").alias("status"))


def deviations(sites: DataFrame, result: DataFrame) -> DataFrame:
    """The sites that don't follow the majority, with the pattern they miss."""
    return sites.join(F.broadcast(result.select("pattern")), ~F.col("category").eqNullSafe(F.col("pattern")))


def adherents(sites: DataFrame, result: DataFrame) -> DataFrame:
    return sites.join(F.broadcast(result.select("pattern")), F.col("category").eqNullSafe(F.col("pattern")))


@dataclass(frozen=True)
class Belief:
    """Sites are selected and classified into (site, category); ``min_adherence`` is a fraction."""

    name: str
    classify: Callable[[], DataFrame]
    min_adherence: tuple[int, int] = (1, 2)
    min_sites: int = 3
    source: str = ""  #: expressions as text, for suppression and emission


@dataclass(frozen=True)
class AggregateBelief:
    name: str
    analyze: Callable[[], DataFrame]
    source: str = ""


_SHAPE = "name string, pattern string, adherent long, total long, ratio double, status string, message string, source string"


class Beliefs:
    """A registry of beliefs; results are evaluated in the order of registration, failures stay with their belief."""

    def __init__(self, spark: SparkSession):
        self.spark, self.beliefs, self.aggregates = spark, [], []
        self._sites: dict[str, tuple[DataFrame, DataFrame]] = {}

    def define(self, belief: Belief | AggregateBelief) -> None:
        (self.beliefs if isinstance(belief, Belief) else self.aggregates).append(belief)

    def reset(self) -> None:
        self.beliefs, self.aggregates, self._sites = [], [], {}

    def activate(self, definitions: list[dict], classifier: Callable[[str], Callable[[], DataFrame]]) -> list[str]:
        """Define beliefs from committed definitions (name, source, threshold), ``classifier`` making a source's sites; names that exist are left alone."""
        known, added = {b.name for b in self.beliefs}, []
        for d in definitions:
            if d["name"] not in known:
                n, m, least = d.get("threshold", (1, 2, 3))
                self.define(Belief(d["name"], classifier(d["source"]), (n, m), least, d["source"]))
                known.add(d["name"])
                added.append(d["name"])
        return added

    @contextmanager
    def scope(self):
        """Registries as they were, afterwards, whatever happens inside."""
        saved = self.beliefs, self.aggregates, self._sites
        self.beliefs, self.aggregates, self._sites = list(saved[0]), list(saved[1]), dict(saved[2])
        try:
            yield self
        finally:
            self.beliefs, self.aggregates, self._sites = saved

    def run(self) -> DataFrame:
        """(name, pattern, adherent, total, ratio, status, message, source); status strong, weak, no-sites or error.

        Every belief's votes are counted here, so that one that fails while it runs leaves the others alone.
        """
        out = self.spark.createDataFrame([], _SHAPE)
        for b in self.beliefs:
            try:
                sites = b.classify()
                result = checkpointed(verdict(votes(sites), b.min_adherence, b.min_sites))
                self._sites[b.name] = sites, result
                name = self.spark.range(1).select(F.lit(b.name).alias("name"))
                row = name.join(result, how="left").select("name", "pattern", F.coalesce("adherent", F.lit(0)).cast("long").alias("adherent"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), "ratio", F.coalesce("status", F.lit("no-sites")).alias("status"), F.lit(None).cast("string").alias("message"), F.lit(b.source).alias("source"))
            except (PySparkException, Py4JJavaError, KeyError, ValueError, TypeError) as e:
                row = self.spark.createDataFrame([(b.name, None, 0, 0, None, "error", str(e).split("\n")[0], b.source)], _SHAPE)
            out = out.unionByName(row)
        return out

    def run_aggregates(self) -> dict[str, DataFrame | str]:
        found: dict[str, DataFrame | str] = {}
        for a in self.aggregates:
            try:
                found[a.name] = a.analyze()
            except (PySparkException, Py4JJavaError, KeyError, ValueError, TypeError) as e:
                found[a.name] = f"error: {e}"
        return found

    def sites_from(self, name: str, which: str = "adherence") -> DataFrame:
        if name not in self._sites:
            raise KeyError(f"no result of belief {name}")
        sites, result = self._sites[name]
        return adherents(sites, result) if which == "adherence" else deviations(sites, result)

    def emit(self, results: DataFrame) -> DataFrame:
        """(name, text): a definition of each strong belief, with its configured thresholds."""
        by = {b.name: b for b in self.beliefs}
        rows = [(n, json.dumps({"name": n, "source": b.source, "threshold": [*b.min_adherence, b.min_sites]}, sort_keys=True)) for n, b in by.items()]
        texts = self.spark.createDataFrame(rows, "name string, text string")
        return results.where("status = 'strong'").select("name").join(texts, "name")


def suppress_known(results: DataFrame, committed: DataFrame, on: str = "source") -> DataFrame:
    """Results whose expression equals no committed one; those without an expression pass."""
    return results.join(committed.where(F.col(on).isNotNull() & (F.col(on) != "")).select(on).distinct(), on, "left_anti")


def load_committed(path: str) -> list[dict]:
    """Belief definitions of a JSON file or of a folder's files, in order of name; bad files are skipped with a warning."""
    p = pathlib.Path(path)
    out = []
    for f in sorted(p.glob("*.json")) if p.is_dir() else [p]:
        try:
            got = json.loads(f.read_text())
            out += got if isinstance(got, list) else [got]
        except (OSError, ValueError) as e:
            print(f"skipped {f}: {e}", file=sys.stderr)
    return out


# Checkers: sites (func) and facts to (site, category).  ops: (func, ord, op); calls may carry is_defer.


def contains_call(sites: DataFrame, ops: DataFrame, *names: str) -> DataFrame:
    hit = ops.where(F.col("op").isin(*names)).select("func").distinct().withColumn("hit", F.lit(True))
    return sites.join(hit, "func", "left").select(F.col("func").alias("site"), F.when(F.col("hit"), "present").otherwise("absent").alias("category"))


def paired_with(sites: DataFrame, ops: DataFrame, second: str) -> DataFrame:
    """paired-defer if a deferred call of ``second`` exists, paired-call if another, else unpaired."""
    g = ops.where(F.col("op") == second).groupBy("func").agg(F.max(F.coalesce("is_defer", F.lit(False))).alias("d"))
    return sites.join(g, "func", "left").select(F.col("func").alias("site"), F.when(F.col("d"), "paired-defer").when(F.col("d").isNotNull(), "paired-call").otherwise("unpaired").alias("category"))


def ordered(sites: DataFrame, ops: DataFrame, a: str, b: str, blocks: DataFrame | None = None, broken: DataFrame | None = None) -> DataFrame:
    """Which of the first calls comes first: by position within a block, by dominance (func, node, dominator) between blocks.

    Functions in ``broken`` (func; :func:`.kernels.broken_dominance`) whose calls are in different blocks are malformed-ssa.
    """
    first = lambda x: F.min(F.when(F.col("op") == x, F.struct("block", "ord")))
    ops = ops if "block" in ops.columns else ops.withColumn("block", F.lit(0))
    g = ops.groupBy("func").agg(first(a).alias("a"), first(b).alias("b"))
    same = F.col("a.block") == F.col("b.block")
    t = sites.join(g, "func", "left")
    ab = ba = F.lit(False)
    if blocks is not None:
        for name, lo, hi in (("ab", "a", "b"), ("ba", "b", "a")):
            x = blocks.select(F.col("func").alias("f"), F.col("node").alias("n"), F.col("dominator").alias("m"), F.lit(True).alias(name))
            t = t.join(x, (F.col("func") == F.col("f")) & (F.col(f"{lo}.block") == F.col("m")) & (F.col(f"{hi}.block") == F.col("n")), "left").drop("f", "n", "m")
        ab, ba = _sure(F.col("ab")), _sure(F.col("ba"))
    t, bad = _malformed(t, broken)
    cat = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(bad & ~same, "malformed-ssa").when(same & (F.col("a.ord") <= F.col("b.ord")) | ~same & ab, "a-dominates-b").when(same | ba, "b-dominates-a").otherwise("unordered")
    return t.select(F.col("func").alias("site"), cat.alias("category"))


def _malformed(sites: DataFrame, broken: DataFrame | None) -> tuple[DataFrame, Column]:
    """Sites with whether their function's dominator tree is broken."""
    if broken is None:
        return sites, F.lit(False)
    return sites.join(broken.select("func").distinct().withColumn("bad", F.lit(True)), "func", "left"), _sure(F.col("bad"))


def dominates_call(sites: DataFrame, ops: DataFrame, dominance: DataFrame, a: str, b: str, broken: DataFrame | None = None) -> DataFrame:
    """Whether every block (func, block) that calls ``b`` is dominated (func, node, dominator) by one that calls ``a``; malformed-ssa for ``broken`` (func)."""
    ab = ops.where(F.col("op") == a).select("func", F.col("block").alias("dominator")).distinct()
    bb = ops.where(F.col("op") == b).select("func", F.col("block").alias("node")).distinct()
    good = bb.join(dominance, ["func", "node"]).join(ab, ["func", "dominator"], "left_semi").select("func", "node").distinct().withColumn("ok", F.lit(1))
    g = bb.join(good, ["func", "node"], "left").groupBy("func").agg(F.count(F.lit(1)).alias("nb"), F.count("ok").alias("ok"))
    t = sites.join(g, "func", "left").join(ab.select("func").distinct().withColumn("has", F.lit(True)), "func", "left")
    t, bad = _malformed(t, broken)
    cat = F.when(F.col("nb").isNull() | F.col("has").isNull(), "missing").when(bad, "malformed-ssa").when(F.col("ok") == F.col("nb"), "dominates-all").when(F.col("ok") > 0, "partial").otherwise("none")
    return t.select(F.col("func").alias("site"), cat.alias("category"))


def flows_to_all(sites: DataFrame, starts: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether one start (func, node) reaches every end (func, node) along value edges (func, src, dst)."""
    seed = starts.select("func", F.col("node").alias("root"), "node")
    e = edges.select(F.col("func").alias("f"), "src", "dst")
    reach = grow(seed, lambda x: x.join(e, (x.func == e.f) & (x.node == e.src)).select("func", "root", F.col("dst").alias("node")))
    hit = reach.join(ends.select("func", "node").distinct(), ["func", "node"], "left_semi").groupBy("func", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("func").agg(F.max("n").alias("n"))
    want = ends.groupBy("func").agg(F.countDistinct("node").alias("want"))
    t = sites.join(want, "func", "left").join(starts.select("func").distinct().withColumn("has", F.lit(True)), "func", "left").join(hit, "func", "left")
    cat = F.when(F.col("want").isNull() | F.col("has").isNull(), "missing").when(F.col("n") == F.col("want"), "flows-all").when(F.col("n") > 0, "partial").otherwise("none")
    return t.select(F.col("func").alias("site"), cat.alias("category"))


def single_call_site(sites: DataFrame, ops: DataFrame, name: str) -> DataFrame:
    g = ops.where(F.col("op") == name).groupBy("func").agg(F.count(F.lit(1)).alias("n"))
    return sites.join(g, "func", "left").select(F.col("func").alias("site"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "single").otherwise("multiple").alias("category"))


def reaches_call(sites: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Whether a target (node) is among the transitive callees; the site itself doesn't count, one outside the graph is unresolved."""
    e = placed(edges.select("src", "dst"), "dst", distinct=True)
    into = e.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("func"))
    hit = grow(into, lambda f: f.join(e, f.func == e.dst).select(F.col("src").alias("func")), on="func").withColumn("hit", F.lit(True))
    known = paths.nodes(e).select(F.col("node").alias("func"), F.lit(True).alias("known"))
    t = sites.join(hit, "func", "left").join(known, "func", "left")
    return t.select(F.col("func").alias("site"), F.when(F.col("hit"), "reaches").when(F.col("known"), "unreached").otherwise("unresolved").alias("category"))


def stores_to_fields(access: DataFrame, struct: str, *fields: str) -> DataFrame:
    """(func) that write all the fields of the struct, by relational division."""
    w = access.where((F.col("mode") == "write") & (F.col("struct") == struct) & F.col("field").isin(*fields))
    return w.groupBy("func").agg(F.countDistinct("field").alias("n")).where(F.col("n") == len(set(fields))).select("func")


def co_mutated(sites: DataFrame, access: DataFrame, *fields: str) -> DataFrame:
    """Whether all, some or none of the fields are written, of whatever struct."""
    g = access.where((F.col("mode") == "write") & F.col("field").isin(*fields)).groupBy("func").agg(F.countDistinct("field").alias("n"))
    return sites.join(g, "func", "left").select(F.col("func").alias("site"), F.when(F.col("n") == len(set(fields)), "co-mutated").when(F.col("n") > 0, "partial").otherwise("missing").alias("category"))


def checked_before_use(seeds: DataFrame, edges: DataFrame, guards: DataFrame, fuel: int = 5) -> DataFrame:
    """Whether a value (site, node) reaches a guard (node) in fewer than ``fuel`` def-use steps; NULL nodes are missing."""
    e = edges.select("src", "dst").distinct()
    near = grow(guards.where("node IS NOT NULL").select("node"), lambda f: f.join(e, f.node == e.dst).select(F.col("src").alias("node")), fuel - 1)
    hit = seeds.join(near, "node", "left_semi").select("site").distinct().withColumn("hit", F.lit(True))
    t = seeds.groupBy("site").agg(F.count("node").alias("n")).join(hit, "site", "left")
    return t.select("site", F.when(F.col("n") == 0, "missing").when(F.col("hit"), "guarded").otherwise("unguarded").alias("category"))


def receiver_asymmetry(funcs: DataFrame) -> DataFrame:
    """First rule that holds of per-function facts: found, is_method, recv_writes, n_params, recv_reads, in_interface, forwards."""
    cat = (
        F.when(~F.col("found"), "missing")
        .when(~F.col("is_method"), "no-receiver")
        .when(F.col("recv_writes") > 0, "mutation")
        .when(F.col("n_params") == 0, "accessor")
        .when(F.col("recv_reads") == 0, "unused-recv")
        .when(F.col("recv_reads") > 1, "multi-read")
        .when(F.col("in_interface"), "interface-method")
        .when(F.col("forwards"), "forwarder")
        .otherwise("candidate")
    )
    return funcs.select(F.col("func").alias("site"), cat.alias("category"))


def receiver_facts(funcs: DataFrame, access: DataFrame, params: DataFrame, interfaces: DataFrame, forwards: DataFrame) -> DataFrame:
    """Facts for :func:`receiver_asymmetry` of functions (func, recv_type, short_name).

    ``access`` (func, struct, field, mode) counts distinct fields of the receiver's type, ``params`` (func, ...) parameters;
    a method is in an interface if ``interfaces`` (method, type) has its name for its type, a forwarder if ``forwards`` (func) has it.
    """
    f = funcs.select("func", F.regexp_replace("recv_type", r"^\*", "").alias("recv"), F.col("short_name").alias("method"))
    own = access.join(f.select("func", F.col("recv").alias("struct")), ["func", "struct"], "left_semi").groupBy("func").agg(F.count_distinct(F.when(F.col("mode") == "write", F.col("field"))).alias("recv_writes"), F.count_distinct(F.when(F.col("mode") == "read", F.col("field"))).alias("recv_reads"))
    n = params.groupBy("func").agg(F.count(F.lit(1)).alias("n_params"))
    t = f.join(own, "func", "left").join(n, "func", "left")
    t = t.join(interfaces.select(F.col("type").alias("recv"), "method").distinct().withColumn("in_interface", F.lit(True)), ["recv", "method"], "left")
    t = t.join(forwards.select("func").distinct().withColumn("forwards", F.lit(True)), "func", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.select("func", F.lit(True).alias("found"), F.col("recv").isNotNull().alias("is_method"), zero("recv_writes").alias("recv_writes"), zero("n_params").alias("n_params"), zero("recv_reads").alias("recv_reads"), _sure(F.col("in_interface")).alias("in_interface"), _sure(F.col("forwards")).alias("forwards"))


def conventions(calls: DataFrame, share: tuple[int, int] = (3, 5), min_members: int = 5) -> DataFrame:
    """(type, member, missing): members (type, member, callee) of large types that lack a callee which at least ``share`` of the type's members have."""
    pairs = calls.select("type", "member", "callee").distinct()
    members = pairs.select("type", "member").distinct()
    size = members.groupBy("type").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_members)
    num, den = share
    usual = pairs.groupBy("type", "callee").agg(F.count(F.lit(1)).alias("n")).join(size, "type").where(F.col("n") * den >= F.col("size") * num).select("type", "callee")
    return members.join(usual, "type").join(pairs, ["type", "member", "callee"], "left_anti").select("type", "member", F.col("callee").alias("missing"))
