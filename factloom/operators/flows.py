"""Interprocedural flows: matched call/return paths, taint, dispatch, type narrowing, points-to, dataflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed, grow, kept, named, numbered, placed, settle
from . import paths


def _between(calls: DataFrame) -> DataFrame:
    """The pairs (src, dst) of :func:`balanced` whose nodes differ.

    B -> empty | B B | open(i) B close(i): what is empty is left out, so a pair begins where several callers open one id to one callee.  The fixpoint
    joins opened and closed sites on their id, and extends only pairs that the last round added.
    """
    sites = calls.select(F.col("src").alias("a"), F.col("dst").alias("p"), "id").where("a IS NOT NULL AND p IS NOT NULL AND id IS NOT NULL")
    many = checkpointed(sites.groupBy(F.xxhash64("p", "id").alias("h")).agg(F.min("a").alias("a1"), F.max("a").alias("a2")).where("a1 <> a2").select("h"))
    if many.isEmpty():  # no two callers share an id, so nothing closes what another opened
        return calls.select("src", "dst").limit(0)
    first = checkpointed(sites.join(many, F.xxhash64("p", "id") == many.h, "left_semi").distinct())
    up = checkpointed(sites.distinct())
    x, y = up.alias("x"), up.alias("y")
    differ = lambda df: df.where("src <> dst")

    def step(f: DataFrame, b: DataFrame) -> DataFrame:
        wrapped = x.join(f.alias("b"), F.col("x.p") == F.col("b.src")).join(y, (F.col("b.dst") == F.col("y.p")) & (F.col("x.id") == F.col("y.id"))).select(F.col("x.a").alias("src"), F.col("y.a").alias("dst"))
        after = f.alias("l").join(b.alias("r"), F.col("l.dst") == F.col("r.src")).select("l.src", "r.dst")
        before = b.alias("l").join(f.alias("r"), F.col("l.dst") == F.col("r.src")).select("l.src", "r.dst")
        return differ(wrapped.union(after).union(before))

    l, r = first.alias("l"), first.alias("r")
    b = front = checkpointed(differ(l.join(r, (F.col("l.p") == F.col("r.p")) & (F.col("l.id") == F.col("r.id"))).select(F.col("l.a").alias("src"), F.col("r.a").alias("dst"))).distinct())
    while True:
        front = checkpointed(step(front, b).distinct().join(b, ["src", "dst"], "left_anti"))
        if front.isEmpty():
            return b
        b = checkpointed(b.union(front))


def balanced(calls: DataFrame) -> DataFrame:
    """(src, dst) by paths whose calls and returns match, over call sites (src, dst, id); length 0 included."""
    return paths.nodes(calls).select(F.col("node").alias("src"), F.col("node").alias("dst")).union(_between(calls))


def valid_paths(calls: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) by valid paths: returns that match no call, balanced parts, then calls that don't return.

    With ``sources`` (node) only paths that begin there.  Calls lie by both of their ends, so rounds move pairs only.
    """
    inner = _between(calls)
    returns = placed(inner.select("src", "dst").union(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src", distinct=True)
    calls_in = placed(inner.select("src", "dst").union(calls.select("src", "dst")), "src", distinct=True)
    if sources is None:
        seed = paths.nodes(calls)
    else:
        s = placed(sources.select("node"), "node")  # every node is the first of a call or of its return
        ends = [s.join(e.select(F.col("src").alias("node")), "node", "left_semi") for e in (returns, calls_in)]
        seed = ends[0].union(ends[1])
    up = grow(seed.select(F.col("node").alias("src"), F.col("node").alias("dst")), lambda f: f.alias("f").join(returns.alias("r"), F.col("f.dst") == F.col("r.src")).select("f.src", "r.dst"), on="dst")
    return grow(up, lambda f: f.alias("f").join(calls_in.alias("c"), F.col("f.dst") == F.col("c.src")).select("f.src", "c.dst"), on="dst")


def taint_flows(calls: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """(source, sink) on valid paths; sanitizers (node) and nameless nodes are dropped from the graph first."""
    c = calls.where("src IS NOT NULL AND dst IS NOT NULL")
    if sanitizers is not None:
        s = sanitizers.select("node")
        c = c.join(s, c.src == s.node, "left_anti").join(s, c.dst == s.node, "left_anti")
    v = valid_paths(checkpointed(c), sources)
    return v.join(sinks.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("sink"))


TAINT_SOURCES = ("FormValue", "ReadAll", "Getenv", "Args", "PostFormValue")
TAINT_SINKS = ("Command", "Query", "Exec", "WriteFile", "Redirect", "Execute")
TAINT_SANITIZERS = ("EscapeString", "QuoteMeta")


def from_names(column: str, names) -> Column:
    return F.coalesce(F.col(column).isin(list(names)), F.lit(False))


def from_pattern(column: str, part: str) -> Column:
    return F.coalesce(F.col(column).contains(part), F.lit(False))


DISPATCH_K = 8


def dispatch_sites(edges: DataFrame, site: list[str], candidate: str = "candidate", k: int = DISPATCH_K, every: DataFrame | None = None) -> DataFrame:
    """(site..., n, class, detail, candidates): what a dynamic call may run.

    One candidate is a must, more are a may; more than ``k`` aren't listed (NULL, detail elided).  With ``every`` (site) also sites without
    candidates are given, as none.
    """
    g = edges.groupBy(*site).agg(F.countDistinct(candidate).alias("n"), F.sort_array(F.collect_set(candidate)).alias("candidates"))
    if every is not None:
        g = every.select(*site).distinct().join(g, site, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    cls = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "must").otherwise("may")
    return g.select(*site, "n", cls.alias("class"), F.when(F.col("n") <= k, "full").otherwise("elided").alias("detail"), F.when(F.col("n") <= k, F.col("candidates")).alias("candidates"))


REFLECTION = ("reflect.", "unsafe.")


def dispatch_details(sites: DataFrame, edges: DataFrame, site: list[str], scope: DataFrame) -> DataFrame:
    """``sites`` with iface, method, iface_exported, synthetic_caller and reflection_in_scope.

    ``edges`` (site..., iface, method, caller_synthetic) describe the calls; ``scope`` (name) are all nodes, of which one of reflect or unsafe sets the flag for all sites.
    """
    d = edges.groupBy(*site).agg(F.min("iface").alias("iface"), F.min("method").alias("method"), F.max(F.coalesce("caller_synthetic", F.lit(False))).alias("synthetic_caller"))
    hit = F.lit(False)
    for r in REFLECTION:
        hit = hit | F.coalesce(F.col("name").startswith(r), F.lit(False))
    flag = scope.agg(F.coalesce(F.max(hit), F.lit(False)).alias("reflection_in_scope"))
    return sites.join(d, site, "left").withColumn("iface_exported", exported("iface")).crossJoin(F.broadcast(flag))


def narrowed_from(sites: DataFrame, wide: DataFrame, site: list[str], candidate: str = "candidate") -> DataFrame:
    """``sites`` with the number of candidates in the wider graph; NULL, not 0, where it has none."""
    return sites.join(wide.groupBy(*site).agg(F.countDistinct(candidate).alias("narrowed_from")), site, "left")


def narrowed_by(sites: DataFrame, uses: DataFrame, makers: DataFrame, site: list[str], key: str, candidate: str = "candidate") -> DataFrame:
    """:func:`narrowed_from` for candidates (key, candidate) of what a site uses (site..., key).

    Candidates travel once for a use as the one list of its key, and are united where their site is; pairs of site and candidate are never built.
    """
    each = makers.groupBy(key).agg(F.collect_set(candidate).alias("_c"))
    lists = uses.select(*site, key).distinct().join(each, key).repartition(*site)
    return sites.join(lists.groupBy(*site).agg(F.size(F.array_distinct(F.flatten(F.collect_list("_c")))).cast("long").alias("narrowed_from")), site, "left")


def witnesses(edges: DataFrame, makers: DataFrame, on: str = "candidate") -> DataFrame:
    """Edges with the sorted places (pos) where their candidate is made; NULL without any."""
    return edges.join(makers.groupBy(on).agg(F.sort_array(F.collect_set("pos")).alias("witness")), on, "left")


def exported(column: str) -> Column:
    """Whether the last part of a name starts in upper case; a type literal is unnamed."""
    c = F.col(column)
    last = F.substring_index(c, ".", -1)
    return F.when(c.rlike(r"[{ ]"), "unnamed").when(last.rlike(r"^\p{Lu}"), "true").otherwise("false")


def names_reached(edges: DataFrame, ends: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """((node, word, mask), names): the names (node, ``column``) that each node's ``edges``, placed by dst, lead to, as masks over :func:`numbered` names."""
    ids = numbered(ends, column)
    zero = F.lit(0).cast("long")  # a NULL is no name, but what comes to it comes to an end
    seed = ends.join(ids, column, "left").select("node", F.coalesce("word", zero).alias("word"), F.coalesce("bit", zero).alias("mask"))
    e = edges.select("src", "dst")
    masks = settle(seed, ["node", "word"], "mask", lambda f: f.join(e, f.node == e.dst).select(F.col("src").alias("node"), "word", "mask"), F.bit_or, "node")
    return masks, ids


def name_lists(masks: DataFrame, ids: DataFrame, column: str, alias: str) -> DataFrame:
    """(node, ``alias``): sorted names of each node's masks; a set that many nodes have is named once."""
    sets = kept(masks.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("_set")))
    each = named(sets.select("_set").distinct().select("_set", F.explode("_set").alias("x")).select("_set", "x.word", "x.mask"), ids, column)
    lists = sets.join(each.groupBy("_set").agg(F.sort_array(F.collect_set(column)).alias(alias)), "_set", "left")
    return lists.select("node", F.coalesce(alias, F.array().cast("array<string>")).alias(alias))


def narrow(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(node, confidence, types): terminal types (node, type) that each node's definitions reach.

    A node on or before a cycle is widened, one that reaches no terminal has no-paths, others are narrow.
    """
    e = placed(edges.select("src", "dst"), "dst", distinct=True)
    every = kept(paths.nodes(e))
    wide = kept(paths.endless(e).withColumn("wide", F.lit(True)))
    ends = kept(terminals.join(every, "node", "left_semi").select("node", "type"))
    types = name_lists(*names_reached(e, ends, "type"), "type", "types")
    out = every.join(wide, "node", "left").join(types, "node", "left")
    conf = F.when(F.col("wide"), "widened").when(F.col("types").isNull(), "no-paths").otherwise("narrow")
    return out.select("node", conf.alias("confidence"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def defuse_reachable(edges: DataFrame, seeds: DataFrame, fuel: int) -> DataFrame:
    """(root, node) within ``fuel`` steps along definitions to uses (src, dst); the root is there at step 0."""
    e = placed(edges.select("src", "dst"), "src", distinct=True)
    seed = seeds.select(F.col("node").alias("root"), "node")
    return grow(seed, lambda f: f.join(e, f.node == e.src).select("root", F.col("dst").alias("node")), fuel, "node")


def value_flow(edges: DataFrame, stores: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node): def-use edges (src, dst) and stores (value, aggregate) that taint the aggregate they write into."""
    both = edges.select("src", "dst").union(stores.select(F.col("value"), F.col("aggregate"))).distinct()
    return paths.reachable(both, seeds)


def reaching_definitions(blocks: DataFrame, defs: DataFrame) -> DataFrame:
    """(block, name) entering each block: names (block, name) defined in a block with a path to it; nothing is killed."""
    e = checkpointed(blocks.select("src", "dst").distinct())
    on = lambda f: f.join(e, f.block == e.src).select(F.col("dst").alias("block"), "name")
    return grow(on(defs.select("block", "name")), on)


def liveness(blocks: DataFrame, uses: DataFrame, kills: DataFrame) -> DataFrame:
    """(block, name) live on entry: used (block, name) in it, or live on entry of a successor and not killed (block, name) in it."""
    e = blocks.select("src", "dst").distinct()
    k = kills.select("block", "name").distinct()
    seed = uses.select("block", "name")

    def step(f: DataFrame) -> DataFrame:
        up = f.join(e, f.block == e.dst).select(F.col("src").alias("block"), "name")
        return up.join(k, ["block", "name"], "left_anti")

    return grow(seed, step)


UNKNOWN = "?"


def points_to(copies: DataFrame, allocs: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(value, site): allocation sites (value, site) carried along copies (src, dst); ``unknown`` (value) point to anything."""
    seed = allocs.select("value", "site")
    if unknown is not None:
        seed = seed.union(unknown.select("value", F.lit(UNKNOWN).alias("site")))
    e = placed(copies.select("src", "dst"), "src", distinct=True)
    return grow(seed, lambda f: f.join(e, f.value == e.src).select(F.col("dst").alias("value"), "site"), on="value")


def lock_escape(locks: DataFrame, points: DataFrame, roots_of: DataFrame) -> DataFrame:
    """(site, roots, measure) of locked allocations: how many goroutine roots lock them; unbounded if any lock may point anywhere.

    ``locks`` (func, value), ``points`` (value, site), ``roots_of`` (func, root).
    """
    ids = numbered(roots_of, "root")
    mine = roots_of.join(ids, "root").groupBy("func", "word").agg(F.bit_or("bit").alias("mask"))
    # a value's roots as masks, 0 without any, so that no function travels with the sites of its values
    held = locks.join(mine, "func", "left").select("value", F.coalesce("word", F.lit(0).cast("long")).alias("word"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    held = checkpointed(held.groupBy("value", "word").agg(F.bit_or("mask").alias("mask")))
    at = points.join(held, "value")
    open_ = points.where(F.col("site") == UNKNOWN).join(held, "value", "left_semi").agg(F.count(F.lit(1)).alias("unresolved"))
    words = at.where(F.col("site") != UNKNOWN).groupBy("site", "word").agg(F.bit_or("mask").alias("mask"))
    n = words.groupBy("site").agg(F.sum(F.bit_count("mask")).cast("long").alias("roots"))
    return n.crossJoin(F.broadcast(open_)).select("site", "roots", F.when(F.col("unresolved") > 0, "unbounded").otherwise(F.col("roots").cast("string")).alias("measure"))
