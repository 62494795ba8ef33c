"""Graph operators over edges (src, dst): reachability, components, semirings, dominance, call-graph lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import PARTS, checkpointed, grow, kept, placed, settle


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    flipped = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(flipped.get(c, c)).alias(c) for c in edges.columns])


def _present(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): rows of ``roots`` that are nodes of ``edges``, which are placed by src; targets are looked through only for roots that are no source."""
    r = placed(roots.select("node"), "node")
    heads = edges.select(F.col("src").alias("node"))
    rest = kept(r.join(heads, "node", "left_anti"))
    inside = r.join(heads, "node", "left_semi")
    return inside if rest.isEmpty() else inside.union(rest.join(edges.select(F.col("dst").alias("node")), "node", "left_semi"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): every node that a root (node) reaches, itself included; roots outside the graph reach nothing."""
    e = placed(edges.select("src", "dst"), "src", distinct=True)
    seed = _present(roots, e).select(F.col("node").alias("root"), "node")
    return grow(seed, lambda f: f.join(e, f.node == e.src).select("root", F.col("dst").alias("node")), on="node")


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, node): every node that reaches a target, itself included."""
    return reachable(transpose(edges), targets)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) joined by a path of at least one edge."""
    e = edges.select("src", "dst").distinct()
    return grow(e, lambda f: f.alias("f").join(e.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", "e.dst"))


def _ends(es: DataFrame, ed: DataFrame) -> DataFrame:
    """(node, outs, ins): edges to and from other nodes, of every node of the edges placed by src and by dst; nothing is shuffled."""
    other = F.count(F.when(F.col("src") != F.col("dst"), 1))
    g = es.groupBy(F.col("src").alias("node")).agg(other.alias("outs")).join(ed.groupBy(F.col("dst").alias("node")).agg(other.alias("ins")), "node", "full")
    return g.select("node", F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins"))


def _trim(ends: DataFrame, es: DataFrame | None, ed: DataFrame) -> DataFrame:
    """``ends`` of what is left when nodes without edges out, and with ``es`` those without edges in, go until there are none.

    A node that goes takes one from the counts of its neighbours, so an edge is looked at once for each of its ends.
    """
    gone = "outs = 0" if es is None else "outs = 0 OR ins = 0"
    alive = kept(ends)
    while True:
        dead = alive.where(gone).select(F.col("node").alias("dead"))
        if dead.isEmpty():
            return alive
        less = dead.join(ed.where("src <> dst"), F.col("dead") == ed.dst).select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        if es is not None:
            less = less.union(dead.join(es.where("src <> dst"), F.col("dead") == es.src).select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        less = less.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        rest = alive.where(f"NOT ({gone})").join(less, "node", "left")
        alive = kept(rest.select("node", (F.col("outs") - F.coalesce("o", F.lit(0))).alias("outs"), (F.col("ins") - F.coalesce("i", F.lit(0))).alias("ins")))


def endless(edges: DataFrame) -> DataFrame:
    """(node) on a cycle or before one, of distinct edges placed by dst: what is left when nodes without edges out go, one after the other; a self-loop is a cycle."""
    ed = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    outs = ed.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"))
    nodes_ = ed.groupBy(F.col("dst").alias("node")).agg(F.lit(0).cast("long").alias("ins"))
    ends = nodes_.join(outs, "node", "full").select("node", F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins"))
    return _trim(ends, None, ed).select("node")


def _within(es: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between nodes that are alive, placed by src and by dst."""
    a = alive.select("node")
    half = placed(es.join(a, es.src == a.node, "left_semi"), "dst")
    ed = kept(half.join(a, half.dst == a.node, "left_semi"))
    return placed(ed, "src"), ed


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    What can't be on a cycle is trimmed.  The component of the node with most edges is what it reaches and what reaches it.  As long
    as others are left, each round gives every node the least node that reaches it, and takes from each of those the nodes of its own
    mark that reach it back: whole components, in space linear in the graph.  Edges lie by both of their ends, so rounds move nodes only.
    """
    es = placed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "src", distinct=True)
    ed = placed(es, "dst")
    ends = kept(_ends(es, ed))
    every, found = ends.select("node"), []
    alive = _trim(ends, es, ed)
    if not alive.isEmpty():
        pivot = alive.orderBy(F.desc(F.col("outs").cast("double") * F.col("ins")), "node").limit(1).select("node")
        fore = grow(pivot, lambda f, e=es: f.join(e, f.node == e.src).select(F.col("dst").alias("node")), on="node")
        back = grow(pivot, lambda f, e=ed: f.join(e, f.node == e.dst).select(F.col("src").alias("node")), on="node")
        one = kept(fore.join(back, "node", "left_semi"))
        found.append(one.crossJoin(F.broadcast(one.agg(F.min("node").alias("component")))))
        alive = kept(alive.join(one, "node", "left_anti"))
    while not alive.isEmpty():
        es, ed = _within(es, alive)
        alive = _trim(_ends(es, ed), es, ed)
        if alive.isEmpty():
            break
        mark = kept(settle(alive.select("node", F.col("node").alias("mark")), ["node"], "mark", lambda f, e=es: f.join(e, f.node == e.src).select(F.col("dst").alias("node"), "mark")))
        tail = placed(es.join(mark, es.src == mark.node).select("src", "dst", F.col("mark").alias("ms")), "dst")
        own = kept(tail.join(mark, (tail.dst == mark.node) & (tail.ms == mark.mark)).select("src", "dst"))
        part = grow(mark.where("node = mark").select("node", "mark"), lambda f, e=own: f.join(e, f.node == e.dst).select(F.col("src").alias("node"), "mark"), on="node")
        part = kept(part.select("node", F.col("mark").alias("component")))
        found.append(part)
        alive = kept(alive.join(part, "node", "left_anti"))
    if not found:
        return every.select("node", F.col("node").alias("component"))
    return every.join(reduce(DataFrame.unionByName, found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) on a cycle; a self-loop is one."""
    many = checkpointed(components(edges).where("node <> component"))  # all but the least of theirs
    return many.select("node").union(many.select("component")).union(edges.where("src = dst").select("src")).distinct()


def tropical(edges: DataFrame, roots: DataFrame, weight: str | None = None) -> DataFrame:
    """(root, node, distance): least sum of non-negative weights (1 without ``weight``) from each root; 0 to itself."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = kept(edges.select("src", "dst", w.alias("w")).repartition(n, "src").groupBy("src", "dst").agg(F.min("w").alias("w")))
    seed = _present(roots, e).select(F.col("node").alias("root"), "node", F.lit(0).cast(e.schema["w"].dataType).alias("distance"))
    return settle(seed, ["root", "node"], "distance", lambda f: f.join(e, f.node == e.src).select("root", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance")), on="node")


#: Rounds of path counts after which it is looked whether a root reaches a cycle.
ROUNDS = 16


def count_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, paths): number of paths in an acyclic graph; raises on a cycle that a root reaches."""
    e = placed(edges.select("src", "dst"), "src")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = lambda df: df.groupBy("root", "node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
    front = placed(_present(roots, e).select(F.col("node").alias("root"), "node", F.lit(1).cast("decimal(38,0)").alias("paths")), "node")
    found, rounds = [front], 0
    while True:
        front = kept(many(front.join(e, front.node == e.src).select("root", F.col("dst").alias("node"), "paths").repartition(n, "node")))
        if front.isEmpty():
            return many(reduce(DataFrame.unionByName, found))
        rounds += 1
        if rounds == ROUNDS:
            inside = reachable(e, roots.select("node").distinct()).select(F.col("node").alias("src"))
            if not endless(placed(e.join(inside, "src", "left_semi").select("src", "dst"), "dst", distinct=True)).isEmpty():
                raise ValueError("path counts need an acyclic graph")
        found.append(front)
        if len(found) > PARTS:
            found = [kept(many(reduce(DataFrame.unionByName, found)))]


def dominators(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(node, dominator): d dominates n if every path from the root (node) to n passes d; a node dominates itself.

    By removal: d dominates exactly what the root reaches but no longer reaches without d.  Work is nodes times edges; for many
    graphs of a bounded size, one for each function, see :func:`.kernels.dominators`.
    """
    e = edges.select("src", "dst").distinct()
    inside = checkpointed(reachable(e, root).select("node"))
    e = checkpointed(e.join(inside, e.src == inside.node, "left_semi"))
    pairs = inside.withColumnRenamed("node", "dominator")
    r = root.select("node")
    seed = pairs.crossJoin(F.broadcast(r)).where("node <> dominator").select("dominator", "node")
    free = grow(seed, lambda f: f.join(e, f.node == e.src).select("dominator", F.col("dst").alias("node")).where("node <> dominator"))
    return pairs.join(inside).join(free, ["dominator", "node"], "left_anti").select("node", "dominator")


def immediate_dominators(pairs: DataFrame) -> DataFrame:
    """(node, idom) from all (node, dominator): the strict dominator that all others dominate."""
    strict = pairs.where("node <> dominator")
    depth = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("depth"))
    return strict.join(depth.withColumnRenamed("node", "dominator"), "dominator").groupBy("node").agg(F.max_by("dominator", "depth").alias("idom"))


def simple_paths(edges: DataFrame, src, dst, fuel: int = 10) -> DataFrame:
    """(path): the paths without repeated nodes from ``src`` to ``dst`` of at most ``fuel`` edges.

    Only nodes that ``src`` reaches and from which ``dst`` is reached within the fuel are walked, so nearly all beginnings of paths come to an end.
    """
    e = placed(edges.select("src", "dst"), "dst", distinct=True)
    start = e.where(e.src == src).select(F.col("src").alias("node")).union(e.where(e.dst == src).select("dst")).distinct()
    stop = e.where(e.dst == dst).select(F.col("dst").alias("node")).union(e.where(e.src == dst).select("src")).distinct()
    back = kept(grow(stop, lambda f: f.join(e, f.node == e.dst).select(F.col("src").alias("node")), fuel, "node"))
    near = checkpointed(e.join(back, e.dst == back.node, "left_semi").join(back, e.src == back.node, "left_semi"))
    front = checkpointed(start.join(back, "node", "left_semi").select(F.array("node").alias("path")))
    found, last = [], F.element_at("path", -1)
    for _ in range(fuel + 1):
        if front.isEmpty():
            break
        found.append(front.where(last == dst))
        out = front.join(near, (last == near.src) & (last != F.lit(dst)) & ~F.array_contains("path", near.dst))
        front = checkpointed(out.select(F.concat("path", F.array("dst")).alias("path")))  # each way leads to another path, so none is found twice
    return reduce(DataFrame.unionByName, found) if found else front


def callers(edges: DataFrame, name) -> DataFrame:
    """Edges into ``name``; each edge is a row, duplicates kept."""
    return edges.where(F.col("dst") == name)


def callees(edges: DataFrame, name) -> DataFrame:
    return edges.where(F.col("src") == name)


def name_matches(column: str, query: str):
    """A name with ``.`` or ``(`` must match exactly, another one also as suffix after ``.`` or ``)``."""
    c = F.col(column)
    if "." in query or "(" in query:
        return c == query
    return (c == query) | c.endswith("." + query) | c.endswith(")" + query)
