"""Ready-made analyses over a fact catalog; each gives an envelope of version, provenance and result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import concepts as C
from ..operators import trees as T
from ..operators.findings import envelope, finding
from ..sources.catalog import FactCatalog
from .fixpoint import checkpointed


def located(rows: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """``rows`` with ``where``: the greatest place (func, pos) of their function, NULL without any."""
    pos = positions.groupBy(F.col("func").alias(key)).agg(F.max("pos").alias("where"))
    return rows.join(pos, key, "left")


def check_beliefs(beliefs: B.Beliefs) -> dict:
    return envelope(beliefs.run(), {"pipeline": "check-beliefs", "beliefs": [b.name for b in beliefs.beliefs]})


def discover_beliefs(beliefs: B.Beliefs, committed: DataFrame) -> dict:
    """Strong results whose name isn't committed yet, as definitions; with the raw and the filtered count."""
    raw = checkpointed(beliefs.run().where("status = 'strong'"))
    new = checkpointed(B.suppress_known(raw, committed, "name"))
    out = envelope(beliefs.emit(new), {"pipeline": "discover-beliefs"})
    return out | {"raw": raw.count(), "filtered": new.count()}


def recommend_split(catalog: FactCatalog, least_idf: float = C.NOISE_IDF, max_attributes: int = 30, refine: bool = False) -> dict:
    """Split of a package's functions by what they import, or by the objects that they use of it."""
    refs = catalog.table("func_ref")
    signatures = C.import_signatures(refs)
    weights = C.idf(signatures, catalog.table("func").select("func").union(refs.select("func")).distinct())
    kept = C.filter_noise(signatures, weights, least_idf)
    if refine:
        ctx = C.refine_by_api(refs.withColumnRenamed("object", "name"), kept)
    else:
        ctx = C.context(kept.select(F.col("func").alias("object"), F.col("ref_pkg").alias("attribute")))
    result = C.recommend_split(ctx, refs.select("func", F.col("object").alias("name")), max_attributes)
    return envelope(result, {"pipeline": "recommend-split", "idf": least_idf, "max_attributes": max_attributes, "refine": refine})


def recommend_boundaries(catalog: FactCatalog, mode: str = "write-only") -> dict:
    """Frontiers of split, merge and extract candidates; the result is a dict of three tables."""
    ctx = checkpointed(C.field_context(catalog.table("field_access"), mode))
    found = checkpointed(C.concepts(ctx))
    result = {
        "split": C.pareto_frontier(checkpointed(C.split_candidates(found)), ["pairs", "disjointness", "balance"]),
        "merge": C.pareto_frontier(checkpointed(C.merge_candidates(found, ctx)), ["extent_count", "intent_overlap"]),
        "extract": C.pareto_frontier(checkpointed(C.extract_candidates(found)), ["extent_ratio", "intent_size"]),
    }
    return envelope(result, {"pipeline": "recommend-boundaries", "mode": mode})


def false_boundaries(catalog: FactCatalog, mode: str = "write-only", min_extent: int = 2, min_intent: int = 2, min_types: int = 2) -> dict:
    """Findings of functions that change several types together, one for each function of a crossing concept."""
    access = catalog.table("field_access")
    cross = C.cross_boundary(C.concepts(C.field_context(access, mode)), min_extent, min_intent, min_types)
    rows = located(cross.select(F.explode("extent").alias("func"), F.array_join("types", "+").alias("types"), F.array_join("intent", ",").alias("fields"), "n_objs"), "func", access)
    f = finding(F.col("func"), F.col("where"), "false-boundary", {"types": F.col("types"), "fields": F.col("fields")}, F.col("n_objs"))
    return envelope(rows.select(f.alias("finding")), {"pipeline": "find-false-boundaries", "mode": mode})


def duplicates(catalog: FactCatalog, threshold: float = 0.6) -> dict:
    """Pairs of functions that share references worth knowing, with tier, verdict and scores; the threshold sets tiers, it filters nothing."""
    refs = catalog.table("func_ref")
    signatures = C.import_signatures(refs)
    kept = C.filter_noise(signatures, C.idf(signatures, refs.select("func").distinct()))
    keys = kept.select(F.col("func").alias("item"), F.col("ref_pkg").alias("key"))
    pairs = checkpointed(C.duplicate_pairs(keys.select("item").distinct(), keys))
    leaves = catalog.table("node").select("tree", F.array_join("path", "/").alias("path"), "field", "vtype", "value")
    scores = T.unifiable(T.score(T.collapse(T.tree_diff(pairs, leaves))), threshold)
    edges = catalog.callgraph("rta", "vta", "cha", "static").groupBy(F.col("callee").alias("item")).agg(F.collect_set("caller").alias("callers"))
    side = lambda x: edges.select(F.col("item").alias(x), F.col("callers").alias(f"c{x}"))
    empty = F.array().cast("array<string>")
    out = scores.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"ca": F.coalesce("ca", empty), "cb": F.coalesce("cb", empty)})
    out = out.withColumn("tier", C.tier(F.col("unifiable"), F.col("similarity"), threshold))
    return envelope(out.select("a", "b", "tier", C.verdict("tier").alias("verdict"), "shared", "similarity", "type_params", "value_params", C.new_edges("ca", "cb").alias("new_edges")), {"pipeline": "find-duplicates", "threshold": threshold})
