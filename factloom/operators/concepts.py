"""Formal concepts of (object, attribute) tables; boundaries, package splits, recommendations, duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed, grow, placed

MAX_ATTRIBUTES = 63  #: of a bit mask


def context(pairs: DataFrame) -> DataFrame:
    return pairs.select("object", "attribute").where("object IS NOT NULL AND attribute IS NOT NULL").distinct()


def intent(ctx: DataFrame, objects: DataFrame) -> DataFrame:
    """(attribute) common to all the objects (object); all attributes for none."""
    n = objects.select("object").distinct().agg(F.count(F.lit(1)).alias("n"))
    hits = ctx.join(objects.select("object").distinct(), "object", "left_semi").groupBy("attribute").agg(F.count(F.lit(1)).alias("hits"))
    every = ctx.select("attribute").distinct()
    return every.join(hits, "attribute", "left").crossJoin(F.broadcast(n)).where(F.coalesce("hits", F.lit(0)) == F.col("n")).select("attribute")


def extent(ctx: DataFrame, attributes: DataFrame) -> DataFrame:
    """(object) having all the attributes (attribute); all objects for none."""
    flip = lambda d: d.select(F.col("attribute").alias("object"), *([F.col("object").alias("attribute")] if "object" in d.columns else []))
    return intent(flip(ctx), flip(attributes)).withColumnRenamed("attribute", "object")


def masks(ctx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((attribute, bit), (object, mask)); raises beyond MAX_ATTRIBUTES."""
    attrs = checkpointed(ctx.select("attribute").distinct().withColumn("bit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("attribute")) - 1))
    if attrs.count() > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes; filter or group them first")
    objs = ctx.join(F.broadcast(attrs), "attribute").groupBy("object").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    return attrs, objs


def concepts(ctx: DataFrame) -> DataFrame:
    """(intent, extent, n_attrs, n_objs): all closed pairs, as sorted arrays, top and bottom included.

    Intents are the closure of the objects' attribute masks under intersection, with all attributes.
    """
    attrs, objs = masks(ctx)
    objs = checkpointed(objs)
    base = objs.select("mask").distinct()
    full = attrs.agg(F.coalesce(F.expr("bit_or(shiftleft(1L, bit))"), F.lit(0).cast("long")).alias("mask"))
    b = base.withColumnRenamed("mask", "other")
    closed = grow(base.union(full), lambda f: f.crossJoin(b).select((F.col("mask").bitwiseAND(F.col("other"))).alias("mask")))
    names = closed.join(F.broadcast(attrs), F.expr("(shiftright(mask, bit) & 1) = 1"), "left").groupBy("mask").agg(F.sort_array(F.collect_list("attribute")).alias("intent"))
    own = objs.withColumnRenamed("mask", "own")
    members = closed.join(own, F.expr("(own & mask) = mask"), "left").groupBy("mask").agg(F.sort_array(F.collect_list("object")).alias("extent"))
    return names.join(members, "mask").select("intent", "extent", F.size("intent").alias("n_attrs"), F.size("extent").alias("n_objs"))


def subset(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def relationship(a: str, b: str) -> Column:
    """How the concept of intent ``a`` stands to that of intent ``b``."""
    return F.when(subset(a, b) & subset(b, a), "equal").when(subset(b, a), "subconcept").when(subset(a, b), "superconcept").otherwise("incomparable")


def structs_of(intent_: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(intent_, lambda a: F.split_part(a, F.lit("."), F.lit(1)))))


def cross_boundary(found: DataFrame, min_extent: int = 2, min_intent: int = 2, min_types: int = 2) -> DataFrame:
    t = found.withColumn("types", structs_of("intent"))
    return t.where((F.col("n_objs") >= min_extent) & (F.col("n_attrs") >= min_intent) & (F.size("types") >= min_types))


def boundary_report(crossing: DataFrame) -> DataFrame:
    """(types, fields, functions, extent_size): fields grouped by struct, as ``struct{a,b}``."""
    t = crossing.withColumn("fields", F.transform("types", lambda s: F.concat(s, F.lit("{"), F.array_join(F.transform(F.filter("intent", lambda a: F.split_part(a, F.lit("."), F.lit(1)) == s), lambda a: F.substring_index(a, ".", -1)), ","), F.lit("}"))))
    return t.select(F.array_join("types", "+").alias("types"), F.array_join("fields", ";").alias("fields"), F.array_join("extent", ",").alias("functions"), F.col("n_objs").alias("extent_size"))


def annotated_report(crossing: DataFrame) -> DataFrame:
    """Each crossing concept with how many others it is below, above and incomparable with."""
    a = crossing.select("intent", "extent", F.when(F.size("types") == 0, "(top)").otherwise(F.array_join("types", "+")).alias("summary"))
    b = crossing.select(F.col("intent").alias("other"))
    rel = a.join(b, F.array_join("intent", ",") != F.array_join("other", ","), "left").withColumn("rel", F.when(F.col("other").isNotNull(), relationship("intent", "other")))
    n = lambda k: F.count(F.when(F.col("rel") == k, 1))
    return rel.groupBy("intent", "extent", "summary").agg(n("subconcept").alias("subconcept_of"), n("superconcept").alias("superconcept_of"), n("incomparable").alias("incomparable_with"))


def field_context(access: DataFrame, mode: str = "write-only", cross_type_only: bool = False) -> DataFrame:
    """(object, attribute) from field accesses (func, struct, field, mode)."""
    name = F.concat_ws(".", "struct", "field")
    if mode == "write-only":
        t = access.where(F.col("mode") == "write").withColumn("attribute", name)
    elif mode == "read-write":
        t = access.withColumn("attribute", F.concat(name, F.when(F.col("mode") == "write", ":w").otherwise(":r")))
    elif mode == "type-only":
        t = access.withColumn("attribute", F.col("struct"))
    else:
        raise ValueError(f"unknown mode {mode}")
    if cross_type_only:
        many = t.groupBy("func").agg(F.countDistinct("struct").alias("n")).where("n >= 2").select("func")
        t = t.join(many, "func", "left_semi")
    return context(t.select(F.col("func").alias("object"), "attribute"))


def propagate_writes(writes: DataFrame, edges: DataFrame) -> DataFrame:
    """(func, attribute): own writes and those of all transitive callees; on cycles, of the whole component."""
    e = placed(edges.select("src", "dst"), "dst", distinct=True)
    return grow(writes.select("func", "attribute"), lambda f: f.join(e, f.func == e.dst).select(F.col("src").alias("func"), "attribute"), on="func")


# Package splits

NOISE_IDF = 0.36


def import_signatures(refs: DataFrame) -> DataFrame:
    return refs.select("func", "ref_pkg").where("ref_pkg IS NOT NULL").distinct()


def idf(signatures: DataFrame, funcs: DataFrame) -> DataFrame:
    """(ref_pkg, df, idf): ln(N / df), N counting functions without references too."""
    n = funcs.select("func").distinct().agg(F.count(F.lit(1)).alias("n"))
    return signatures.groupBy("ref_pkg").agg(F.countDistinct("func").alias("df")).crossJoin(F.broadcast(n)).select("ref_pkg", "df", F.ln(F.col("n").cast("double") / F.col("df")).alias("idf"))


def filter_noise(signatures: DataFrame, weights: DataFrame, least: float = NOISE_IDF) -> DataFrame:
    return signatures.join(weights.where(F.col("idf") >= least).select("ref_pkg"), "ref_pkg", "left_semi").select("func", "ref_pkg")


def refine_by_api(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """(object, attribute) with attributes ``pkg:object`` of the kept packages."""
    t = refs.join(kept.select("ref_pkg").distinct(), "ref_pkg", "left_semi")
    return context(t.select(F.col("func").alias("object"), F.concat_ws(":", "ref_pkg", "name").alias("attribute")))


def find_split(ctx: DataFrame) -> DataFrame:
    """(object, side): a, b or cut by the best pair of concepts with incomparable extents.

    Best: greatest smaller extent, then coverage, then the intents in order.  Objects in both extents are cut,
    those in neither go to the side with which they share more attributes, on a tie they are cut.  No pair, no rows.
    """
    c = checkpointed(concepts(ctx).where("n_objs > 1"))
    a = c.select(F.col("intent").alias("ia"), F.col("extent").alias("ea"), F.col("n_objs").alias("na"))
    b = c.select(F.col("intent").alias("ib"), F.col("extent").alias("eb"), F.col("n_objs").alias("nb"))
    pair = a.join(b, (F.array_join("ia", ",") < F.array_join("ib", ",")) & ~subset("ea", "eb") & ~subset("eb", "ea"))
    best = checkpointed(pair.orderBy(F.desc(F.least("na", "nb")), F.desc(F.size(F.array_union("ea", "eb"))), F.array_join("ia", ","), F.array_join("ib", ",")).limit(1))
    t = ctx.groupBy("object").agg(F.collect_set("attribute").alias("attrs")).crossJoin(F.broadcast(best))
    in_a, in_b = F.array_contains("ea", F.col("object")), F.array_contains("eb", F.col("object"))
    la, lb = F.size(F.array_intersect("attrs", "ia")), F.size(F.array_intersect("attrs", "ib"))
    side = F.when(in_a & in_b, "cut").when(in_a, "a").when(in_b, "b").when(la > lb, "a").when(lb > la, "b").otherwise("cut")
    return t.select("object", side.alias("side"))


def verify_acyclic(sides: DataFrame, refs: DataFrame) -> DataFrame:
    """(a_refs_b, b_refs_a, acyclic): how many functions of a side refer (func, name) to one of the other."""
    to = sides.select(F.col("object").alias("name"), F.col("side").alias("to"))
    t = refs.join(sides.withColumnRenamed("object", "func"), "func").join(to, "name")
    n = lambda x, y: F.count_distinct(F.when((F.col("side") == x) & (F.col("to") == y), F.col("func")))
    return t.agg(n("a", "b").alias("a_refs_b"), n("b", "a").alias("b_refs_a")).withColumn("acyclic", (F.col("a_refs_b") == 0) | (F.col("b_refs_a") == 0))


def recommend_split(ctx: DataFrame, refs: DataFrame, max_attributes: int = 30) -> DataFrame:
    """(functions, group_a, group_b, cut, cut_ratio, acyclic, confidence); NONE under 2 objects or over ``max_attributes``."""
    ctx = checkpointed(ctx)
    n, attrs = ctx.select("object").distinct().count(), ctx.select("attribute").distinct().count()
    spark = ctx.sparkSession
    if n < 2 or attrs > max_attributes:
        return spark.range(1).select(F.lit(n).cast("long").alias("functions"), *[F.lit(0).cast("long").alias(c) for c in ("group_a", "group_b", "cut")], F.lit(1.0).alias("cut_ratio"), F.lit(True).alias("acyclic"), F.lit("NONE").alias("confidence"))
    sides = checkpointed(find_split(ctx))
    count = lambda s: F.count(F.when(F.col("side") == s, 1))
    g = sides.agg(count("a").alias("group_a"), count("b").alias("group_b"), count("cut").alias("cut")).withColumn("functions", F.lit(n).cast("long"))
    g = g.withColumn("cut_ratio", F.when(F.col("group_a") + F.col("group_b") + F.col("cut") == 0, 1.0).otherwise(F.col("cut") / F.col("functions")))
    g = g.crossJoin(F.broadcast(verify_acyclic(sides, refs).select("acyclic")))
    conf = F.when((F.col("group_a") == 0) | (F.col("group_b") == 0), "NONE").when(F.col("acyclic") & (F.col("cut_ratio") <= 0.15), "HIGH").when(F.col("acyclic") & (F.col("cut_ratio") <= 0.30), "MEDIUM").otherwise("LOW")
    return g.select("functions", "group_a", "group_b", "cut", F.round("cut_ratio", 6).alias("cut_ratio"), "acyclic", conf.alias("confidence"))


# Recommendations


def dominates(a: str, b: str, factors: list[str]) -> Column:
    """Row alias ``a`` is nowhere worse than ``b`` and somewhere better; NULL is the worst."""
    ge, gt = F.lit(True), F.lit(False)
    for f in factors:
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        ge = ge & F.coalesce(x >= y, y.isNull())
        gt = gt | F.coalesce(x > y, x.isNotNull() & y.isNull())
    return ge & gt


def _skyline(x: np.ndarray) -> np.ndarray:
    """Whether no row of ``x`` dominates each row; greater is better."""
    order = np.argsort(-x.sum(1), kind="stable")  # a dominating row has the greater sum, so it comes first
    with np.errstate(invalid="ignore"):
        kept = np.zeros((0, x.shape[1]))
        ok = np.zeros(len(x), bool)
        for lo in range(0, len(order), 512):
            part = x[order[lo : lo + 512]]
            beaten = np.zeros(len(part), bool)
            for i in range(0, len(kept), 4096):
                k = kept[i : i + 4096]
                beaten |= ((k[None] >= part[:, None]).all(2) & (k[None] > part[:, None]).any(2)).any(1)
            inner = (part[None] >= part[:, None]).all(2) & (part[None] > part[:, None]).any(2)
            good = ~beaten & ~(inner & ~beaten[None]).any(1)
            ok[order[lo : lo + 512][good]] = True
            kept = np.concatenate([kept, part[good]])
    return ok


def _local_frontier(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Rows that no row of their partition dominates."""

    def run(batches):
        best: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b] if best is None else [*best.to_batches(), b])
            x = np.stack([np.array([-np.inf if v is None else float(v) for v in t[f"__{i}"].to_pylist()]) for i in range(len(factors))], 1)
            best = t.filter(pa.array(_skyline(x)))
        if best is not None:
            yield from best.drop_columns([f"__{i}" for i in range(len(factors))]).to_batches()

    wide = rows.select("*", *[F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(factors)])
    return wide.mapInArrow(run, rows.schema)


def pareto_frontier(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Rows that no row dominates, by numbers or truth values up to 2**53; NULL is the worst.

    Every partition first keeps its own frontier, so only those rows are compared with each other.
    """
    near = checkpointed(_local_frontier(rows, factors))
    return near.alias("r").join(near.alias("o"), dominates("o", "r", factors), "left_anti")


def pareto_dominated(rows: DataFrame, key: str, factors: list[str]) -> DataFrame:
    """(key, dominator): each dominated row with the least frontier row that dominates it."""
    front = checkpointed(pareto_frontier(rows, factors))
    return rows.alias("r").join(front.alias("o"), dominates("o", "r", factors)).groupBy(F.col(f"r.{key}").alias(key)).agg(F.min(f"o.{key}").alias("dominator"))


def split_candidates(found: DataFrame) -> DataFrame:
    """(func, pairs, disjointness, balance): objects of several incomparable concepts below the top, with the best pair's factors."""
    top = found.agg(F.max("n_objs").alias("top"))
    c = found.crossJoin(F.broadcast(top)).where("n_objs < top AND n_objs > 0 AND n_attrs > 0").select("intent", "extent", "n_objs", F.explode("extent").alias("func"))
    a = c.select("func", F.col("intent").alias("ia"), F.col("n_objs").alias("na"))
    b = c.select("func", F.col("intent").alias("ib"), F.col("n_objs").alias("nb"))
    p = a.join(b, "func").where((F.array_join("ia", ",") < F.array_join("ib", ",")) & ~subset("ia", "ib") & ~subset("ib", "ia"))
    p = p.withColumn("disjointness", F.round(1 - F.size(F.array_intersect("ia", "ib")) / F.size(F.array_union("ia", "ib")), 6)).withColumn("balance", F.round(F.least("na", "nb") / F.greatest("na", "nb"), 6))
    return p.groupBy("func").agg(F.count(F.lit(1)).alias("pairs"), F.max("disjointness").alias("disjointness"), F.max("balance").alias("balance"))


def merge_candidates(found: DataFrame, ctx: DataFrame) -> DataFrame:
    """(intent, extent_count, intent_overlap): concepts of several objects, and their intent over all that these objects touch."""
    own = ctx.groupBy("object").agg(F.collect_set("attribute").alias("attrs"))
    c = found.where("n_objs >= 2 AND n_attrs > 0").select("intent", "n_objs", "n_attrs", F.explode("extent").alias("object")).join(own, "object")
    g = c.groupBy("intent", "n_objs", "n_attrs").agg(F.size(F.array_distinct(F.flatten(F.collect_list("attrs")))).alias("touched"))
    return g.select("intent", F.col("n_objs").alias("extent_count"), F.round(F.col("n_attrs") / F.col("touched"), 6).alias("intent_overlap"))


def extract_candidates(found: DataFrame) -> DataFrame:
    """(intent, narrow, extent_ratio, intent_size): a broad concept with its largest strictly narrower one (ties by intent)."""
    a = found.where("n_objs > 0 AND n_attrs > 0").select("intent", F.col("n_objs").alias("broad"), F.col("n_attrs").alias("intent_size"))
    b = found.where("n_objs > 0").select(F.col("intent").alias("narrow"), F.col("n_objs").alias("n"))
    p = a.join(b, subset("intent", "narrow") & (F.size("narrow") > F.size("intent")))
    w = Window.partitionBy("intent").orderBy(F.desc("n"), F.array_join("narrow", ","))
    return p.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("intent", "narrow", F.round(F.col("n") / F.col("broad"), 6).alias("extent_ratio"), "intent_size")


# Duplicates


def jaccard(a: str, b: str) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def duplicate_pairs(items: DataFrame, by: DataFrame) -> DataFrame:
    """(a, b): pairs of items (item, ...) that share a key (item, key); each pair once.

    For keys that few items share; for any keys, and a bound on the similarity, see :func:`similar_sets`.
    """
    k = by.select("item", "key").distinct()
    return k.alias("x").join(k.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.item") < F.col("y.item"))).select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()


#: Items of a key beyond which it is compared by sizes.
FREQUENT = 1000


def similar_sets(by: DataFrame, least: tuple[int, int] = (2, 5)) -> DataFrame:
    """(a, b, similarity, same): items (item, key) whose sets of keys have a Jaccard similarity of at least the fraction ``least``.

    Items with equal sets are a class: its least item stands for it, and each other one is a row with it (same).  Pairs are between
    such items, a before b.  Exact by prefixes: keys are ordered by rarity, and two sets of given sizes that are alike enough share a
    key among so many of their rarest that the common keys left over can't do; a key that a third of the items have is compared only
    where the sizes leave no other.
    """
    p, q = least
    k = checkpointed(by.select("item", "key").where("item IS NOT NULL AND key IS NOT NULL").distinct())
    # keys as numbers in order of rarity: sets of them are short, and the first frequent one tells all others
    n = k.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ids = checkpointed(n.orderBy("n", "key").select("key", "n", F.monotonically_increasing_id().alias("id")))
    hot = ids.agg(F.coalesce(F.min(F.when(F.col("n") > FREQUENT, F.col("id"))), F.lit(2**62)).alias("hot"))
    sets = k.join(ids.select("key", "id"), "key").groupBy("item").agg(F.array_sort(F.collect_list("id")).alias("keys"))
    sets = checkpointed(sets.withColumn("first", F.min("item").over(Window.partitionBy("keys"))))
    same = sets.where("item <> first").select(F.col("first").alias("a"), F.col("item").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same"))
    own = sets.where("item = first").select("item", "keys", F.size("keys").alias("size"))
    sizes = own.select("size").distinct().agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    overlap = lambda m: F.ceil((F.col("size") + m) * p / (p + q))
    # a row for each key of the longest prefix, which the least similar size asks for; of a frequent key one for each other size
    others = F.filter("sizes", lambda m: (m * q >= F.col("size") * p) & (F.col("size") * q >= m * p))
    head = own.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(hot)).withColumn("others", others)
    head = head.withColumn("prefix", F.slice("keys", F.lit(1), (F.col("size") - overlap(F.get("others", F.lit(0))) + 1).cast("int")))
    head = head.select("item", "keys", "size", "hot", "others", F.posexplode("prefix").alias("at", "mark"))
    wanted = F.filter("others", lambda m: F.col("at") <= F.col("size") - overlap(m))
    mark = head.select("item", "keys", "size", "at", "mark", F.explode(F.when(F.col("mark") < F.col("hot"), F.array(F.lit(0))).otherwise(wanted)).alias("other"))
    mark = mark.withColumn("own", F.when(F.col("other") == 0, 0).otherwise(F.col("size")))
    x, y = mark.alias("x"), mark.alias("y")
    met = (F.col("x.mark") == F.col("y.mark")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own")) & (F.col("x.item") < F.col("y.item"))
    # as many keys as can be common if the mark is one, at its places
    most = F.least("x.at", "y.at") + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    met = met & (most * (p + q) >= (F.col("x.size") + F.col("y.size")) * p)
    shared = F.array_intersect("x.keys", "y.keys")
    common = F.size(shared)
    whole = F.col("x.size") + F.col("y.size") - common
    # a pair is taken at its first common key, so it is there once
    near = x.join(y, met).where((common * q >= whole * p) & (F.get(shared, F.lit(0)) == F.col("x.mark")))
    return same.unionByName(near.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"), (common / whole).alias("similarity"), F.lit(False).alias("same")))


def tier(same: Column, similarity: Column, threshold: float = 0.6) -> Column:
    return F.when(same, "proven").when(similarity >= threshold, "structural").otherwise("divergent")


def verdict(tier_: str) -> Column:
    return F.when(F.col(tier_) == "proven", "duplicate").when(F.col(tier_) == "structural", "likely-duplicate").otherwise("distinct")


def locality(same_pkg: Column, callers_a: str, callers_b: str) -> Column:
    return F.when(same_pkg, "same-pkg").when(F.size(F.array_intersect(callers_a, callers_b)) > 0, "shared-callers").otherwise("disjoint")


def new_edges(callers_a: str, callers_b: str) -> Column:
    return F.size(F.array_union(callers_a, callers_b))


def creates_cycle(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with whether merging the two closes a cycle: one of them reaches the other."""
    from . import paths

    p = checkpointed(pairs)
    ends = p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    reach = checkpointed(paths.reachable(edges, ends).where("root <> node"))
    hit = p.select("a", "b").join(reach.select(F.col("root").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_semi")
    back = p.select("a", "b").join(reach.select(F.col("root").alias("b"), F.col("node").alias("a")), ["a", "b"], "left_semi")
    both = hit.union(back.select("a", "b")).distinct().withColumn("creates_cycle", F.lit(True))
    return p.join(both, ["a", "b"], "left").withColumn("creates_cycle", F.coalesce("creates_cycle", F.lit(False)))


# Lattice structure


def meets(found: DataFrame) -> DataFrame:
    """(a, b, join_intent, meet_intent) of every pair of concepts, by intent: the least concept over both and the greatest under both."""
    a = found.select(F.col("intent").alias("a"))
    b = found.select(F.col("intent").alias("b"))
    c = found.select(F.col("intent").alias("c"))
    p = a.crossJoin(b)
    under = p.join(c, subset("a", "c") & subset("b", "c")).groupBy("a", "b").agg(F.min_by("c", F.struct(F.size("c"), F.array_join("c", ","))).alias("meet_intent"))
    return under.select("a", "b", F.array_sort(F.array_intersect("a", "b")).alias("join_intent"), "meet_intent")


def depths(found: DataFrame) -> DataFrame:
    """(intent, depth): length of the longest chain of concepts from the top down to each."""
    from ..plans.fixpoint import settle

    name = F.array_join("intent", ",")
    c = checkpointed(found.select(name.alias("node"), "intent"))
    over = c.alias("x").join(c.alias("y"), subset("x.intent", "y.intent") & (F.size("x.intent") < F.size("y.intent"))).select(F.col("x.node").alias("src"), F.col("y.node").alias("dst"))
    over = checkpointed(over)
    deep = settle(c.select("node", F.lit(0).cast("long").alias("depth")), ["node"], "depth", lambda f: f.join(over, f.node == over.src).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")), F.max)
    return c.join(deep, "node").select("intent", "depth")


def signature(found: DataFrame) -> DataFrame:
    """(object, intents): the concepts that each object belongs to, by their intents."""
    return found.select(F.explode("extent").alias("object"), F.array_join("intent", ",").alias("intent")).groupBy("object").agg(F.sort_array(F.collect_list("intent")).alias("intents"))


def without_cross_flow(candidates: DataFrame, flows: DataFrame) -> DataFrame:
    """Split candidates (func, ...) with whether no value of one side's fields flows to a store of the other's: ``flows`` (func) has those that do."""
    crossing = flows.select("func").distinct().withColumn("no_cross_flow", F.lit(False))
    return candidates.join(crossing, "func", "left").withColumn("no_cross_flow", F.coalesce("no_cross_flow", F.lit(True)))


def cross_flows(loads: DataFrame, stores: DataFrame, edges: DataFrame, fuel: int = 10) -> DataFrame:
    """(func, source, target): structs of one of which a load (func, node, struct) reaches a store (func, node, struct) of another in ``fuel`` def-use steps (func, src, dst)."""
    e = edges.select(F.col("func").alias("f"), "src", "dst").distinct()
    seed = loads.select("func", F.col("struct").alias("source"), "node")
    reach = grow(seed, lambda x: x.join(e, (x.func == e.f) & (x.node == e.src)).select("func", "source", F.col("dst").alias("node")), fuel)
    return reach.join(stores.select("func", "node", F.col("struct").alias("target")), ["func", "node"]).where("source <> target").select("func", "source", "target").distinct()


def single_cluster(ctx: DataFrame, refs: DataFrame, max_attributes: int = 30) -> DataFrame:
    """(verdict, confidence, functions): SPLIT if a split can be recommended with HIGH or MEDIUM confidence, else COHESIVE; for aggregate beliefs."""
    r = recommend_split(ctx, refs, max_attributes)
    return r.select(F.when(F.col("confidence").isin("HIGH", "MEDIUM"), "SPLIT").otherwise("COHESIVE").alias("verdict"), "confidence", "functions")


def split_findings(sides: DataFrame, positions: DataFrame) -> DataFrame:
    """(finding): each function (object) on side a or b of a split, at its place (func, pos)."""
    from .findings import finding

    where = positions.groupBy(F.col("func").alias("object")).agg(F.max("pos").alias("pos"))
    t = sides.where("side IN ('a', 'b')").join(where, "object", "left")
    return t.select(finding(F.col("object"), F.col("pos"), "split-group", {"side": F.col("side")}).alias("finding"))


def pair_findings(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """(finding): each side of scored pairs (a, b, tier, similarity), at its place, with its other side."""
    from .findings import finding

    where = positions.groupBy("func").agg(F.max("pos").alias("pos"))
    both = pairs.select(F.col("a").alias("func"), F.col("b").alias("other"), "tier", "similarity").union(pairs.select("b", "a", "tier", "similarity"))
    return both.join(where, "func", "left").select(finding(F.col("func"), F.col("pos"), "duplicate", {"other": F.col("other"), "tier": F.col("tier")}, F.col("similarity")).alias("finding"))
