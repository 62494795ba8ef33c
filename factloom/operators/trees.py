"""Structural diff and unification of trees held as rows (tree, path, field, vtype, value).

A row is a leaf, a tagged node (vtype ``node``, the tag as value) or a list (vtype ``list``).  Paths are steps joined by ``/``, the
root's path being the first step of all others; inner rows may be left out, then only leaves are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WEIGHTS = {"type-name": 1, "derived-type": 0, "literal-value": 1, "identifier": 0, "register": 0, "operator": 2, "call-target": 3, "structural": 100, "missing-field": 50, "extra-field": 50, "extra-element": 50}
_SOFT = ("type-name", "derived-type", "identifier", "register")


def classify(field: Column, vtype: Column) -> Column:
    """Category of a differing leaf, by the field it stands in and the kind of value."""
    return (
        F.when(vtype == "symbol", "operator")
        .when(vtype.isin("int", "float", "bool"), "literal-value")
        .when(field.isin("type", "inferred-type", "asserted-type"), "type-name")
        .when(field.isin("op", "tok"), "operator")
        .when(field.isin("value", "lit"), "literal-value")
        .when(field.isin("callee", "func"), "call-target")
        .when(field.isin("register", "reg", "operands"), "register")
        .otherwise("identifier")
    )


AST_TYPE_FIELDS = ("type", "inferred-type", "asserted-type", "obj-pkg", "signature")
AST_IDENTIFIER_FIELDS = ("name", "sel", "label")
SSA_SHAPE_FIELDS = ("index", "preds", "succs", "idom", "then", "else", "target")


def classify_ast(field: Column, path: Column, tag: Column) -> Column:
    """Category of two differing strings in a syntax tree; a name below a type field is a type."""
    above = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    in_type = F.exists(above, lambda s: s.isin(*AST_TYPE_FIELDS))
    return (
        F.when(field.isin(*AST_TYPE_FIELDS) | (field == "name") & in_type, "type-name")
        .when(field.isin(*AST_IDENTIFIER_FIELDS), "identifier")
        .when(field == "value", "literal-value")
        .when(field == "tok", "operator")
        .otherwise("identifier")
    )


def classify_ssa(field: Column, path: Column, tag: Column) -> Column:
    """Category of two differing strings in an instruction tree; names of functions and parameters identify, others are registers."""
    return (
        F.when(field.isin("type", "asserted-type"), "type-name")
        .when(field == "op", "operator")
        .when(field.isin("func", "method"), "call-target")
        .when(field.isin(*SSA_SHAPE_FIELDS), "structural")
        .when((field == "name") & ~F.coalesce(tag.isin("ssa-func", "ssa-param"), F.lit(False)), "register")
        .otherwise("identifier")
    )


def tree_diff(pairs: DataFrame, leaves: DataFrame, strings=None) -> DataFrame:
    """(a, b, path, category, left, right) of what each pair (a, b) of trees has at its paths; what is equal is ``shared``.

    An aligned comparison: rows meet on their path, where their pair is.  Nodes of one tag are shared, of two
    structural.  A path that only one side has is a missing or extra field, or an extra element if its last step is a
    position.  Below a structural difference, a missing or an extra one nothing more is compared.  Two different numbers or
    truth values are literals, symbols operators, other kinds structural; two strings are told apart by ``strings``
    (:func:`classify_ast`, :func:`classify_ssa`; by default by field and kind).  ``tag`` in ``leaves`` is the parent's.
    """
    more = [F.col("tag") if "tag" in leaves.columns else F.lit(None).cast("string").alias("tag")]
    own = leaves.groupBy("tree").agg(F.collect_list(F.struct("path", F.struct("field", "vtype", "value", *more).alias("row"))).alias("rows"))
    side = lambda x: F.struct(F.col(x).alias("tree"), F.lit(x).alias("side"))
    trees = pairs.select("a", "b", F.explode(F.array(side("a"), side("b"))).alias("x")).select("a", "b", "x.*").hint("merge").join(own, "tree")  # sizes taken from files don't tell of rows exploded; a broadcast could fill the driver
    # a tree travels once for each pair and side, and all that follows stays where its pair is
    rows = lambda x: F.flatten(F.collect_list(F.when(F.col("side") == x, F.col("rows"))))
    g = trees.groupBy("a", "b").agg(rows("a").alias("l"), rows("b").alias("r"))
    t = g.select("a", "b", _aligned(g.schema["l"].dataType.elementType)("l", "r").alias("rows"))
    stops = F.transform(F.filter("rows", _stops), lambda x: F.concat(x["path"], F.lit("/")))
    t = t.select("a", "b", "rows", stops.alias("stops")).select("a", "b", "stops", F.explode("rows").alias("x")).select("a", "b", "stops", "x.*")
    t = t.where(~F.exists("stops", lambda s: F.startswith("path", s)))
    element = F.substring_index("path", "/", -1).rlike("^[0-9]+$")
    kind = F.col("l.vtype")
    text = classify(F.col("l.field"), kind) if strings is None else strings(F.col("l.field"), F.col("path"), F.col("l.tag"))
    cat = (
        F.when(F.col("l").isNull() | F.col("r").isNull(), F.when(element, "extra-element").when(F.col("r").isNull(), "missing-field").otherwise("extra-field"))
        .when(~kind.eqNullSafe(F.col("r.vtype")), "structural")
        .when(kind == "list", "list")
        .when(F.col("l.value").eqNullSafe(F.col("r.value")), "shared")
        .when(kind == "node", "structural")
        .when(kind == "symbol", "operator")
        .when(kind.isin("int", "float", "bool"), "literal-value")
        .otherwise(text)
    )
    return t.select("a", "b", "path", cat.alias("category"), F.col("l.value").alias("left"), F.col("r.value").alias("right")).where("category <> 'list'")


def _stops(x: Column) -> Column:
    """Whether an inner row differs, so that nothing below it is compared."""
    l, r = x["l"], x["r"]
    differs = l.isNull() | r.isNull() | ~l["vtype"].eqNullSafe(r["vtype"]) | (l["vtype"] == "node") & ~l["value"].eqNullSafe(r["value"])
    return F.coalesce(l["vtype"], r["vtype"]).isin("node", "list") & differs


def _aligned(row: T.StructType):
    """UDF of two arrays of (path, row): array of (path, l, r) of the rows met on their path or alone; a NULL path meets none."""
    inner = T.StructType([T.StructField(f.name, f.dataType) for f in row["row"].dataType])
    out = T.ArrayType(T.StructType([T.StructField("path", row["path"].dataType), T.StructField("l", inner), T.StructField("r", inner)]))
    arrow = to_arrow_type(out)

    @F.arrow_udf(out)
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        n, sides = len(left), (left.flatten(), right.flatten())
        at = [np.repeat(np.arange(n), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (left, right)]
        codes = pa.concat_arrays([x.field(0) for x in sides]).dictionary_encode().indices
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        keys = np.concatenate(at) * (len(codes) + 1) + codes.fill_null(0).to_numpy(zero_copy_only=False)
        keys = np.where(known, keys, -1 - np.arange(len(keys)))
        lk, rk = keys[: len(at[0])], keys[len(at[0]) :]
        order = np.argsort(rk, kind="stable")
        first = np.searchsorted(rk[order], lk, "left")
        met = np.searchsorted(rk[order], lk, "right") - first
        times = np.maximum(met, 1)
        li = np.repeat(np.arange(len(lk)), times)
        step = np.arange(len(li)) - np.repeat(np.cumsum(times) - times, times)
        ri = np.full(len(li), -1)
        some = np.repeat(met > 0, times)
        ri[some] = order[(np.repeat(first, times) + step)[some]]
        rest = np.flatnonzero(~np.isin(rk, lk))
        pair = np.concatenate([at[0][li], at[1][rest]])
        by = np.argsort(pair, kind="stable")
        li, ri = np.concatenate([li, np.full(len(rest), -1)])[by], np.concatenate([ri, rest])[by]
        li, ri = (pa.array(i, mask=i < 0) for i in (li, ri))
        path = pc.coalesce(sides[0].field(0).take(li), sides[1].field(0).take(ri))
        rows = pa.StructArray.from_arrays([path, sides[0].field(1).take(li), sides[1].field(1).take(ri)], ["path", "l", "r"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=n))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), rows).cast(arrow)

    return run


def root_substitutions(pairs: Column) -> Column:
    """Of an array of (left, right) strings those that no shorter ones derive by replacement, shortest first."""
    key = lambda p: F.struct(F.length(p["left"]).alias("n"), p["left"].alias("left"), p["right"].alias("right"))
    order = F.array_sort(F.array_distinct(F.transform(pairs, key)))
    none = F.filter(order, lambda p: F.lit(False))
    step = lambda acc, p: F.when(_derived(acc, p["left"]) == p["right"], acc).otherwise(F.concat(acc, F.array(p)))
    return F.transform(F.aggregate(order, none, step), lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right")))


def _derived(roots: Column, text: Column) -> Column:
    return F.aggregate(roots, text, lambda s, p: F.replace(s, p["left"], p["right"]))


def collapse(diffs: DataFrame) -> DataFrame:
    """``diffs`` with type names that their pair's root substitutions derive as ``derived-type``; (left, right) in ``roots`` stay."""
    pair = F.when(F.col("category") == "type-name", F.struct("left", "right"))
    t = diffs.drop("roots").withColumn("roots", F.collect_set(pair).over(Window.partitionBy("a", "b")))
    t = t.withColumn("roots", F.when(F.size("roots") > 0, root_substitutions(F.col("roots"))))
    is_root = F.exists("roots", lambda p: (p["left"] == F.col("left")) & (p["right"] == F.col("right")))
    return t.withColumn("category", F.when((F.col("category") == "type-name") & ~is_root, "derived-type").otherwise(F.col("category")))


def score(diffs: DataFrame) -> DataFrame:
    """(a, b, shared, diff_count, derived, similarity, effective, type_params, value_params, cost) of each pair, derived types collapsed."""
    n = lambda c: F.count(F.when(c, 1))
    cat = F.col("category")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    g = diffs.groupBy("a", "b").agg(
        n(cat == "shared").alias("shared"),
        n(cat != "shared").alias("diff_count"),
        n(cat == "derived-type").alias("derived"),
        n(cat == "literal-value").alias("value_params"),
        F.collect_list(F.when(cat == "type-name", F.struct("left", "right"))).alias("types"),
        n((cat != "shared") & ~cat.isin(*_SOFT)).alias("hard"),
        F.sum(F.when(cat == "shared", 0).otherwise(F.coalesce(weight[cat], F.lit(10)))).alias("cost"),
    )
    # type names as in :func:`collapse`, but without another pass
    g = g.withColumn("roots", root_substitutions(F.col("types")))
    known = lambda x: F.exists("roots", lambda p: (p["left"] == x["left"]) & (p["right"] == x["right"]))
    gone = F.size(F.filter("types", lambda x: ~known(x))).cast("long")
    params = F.size(F.array_distinct(F.filter("types", lambda x: F.coalesce(known(x), F.lit(True))))).cast("long")
    g = g.withColumns({"gone": gone, "type_params": params})
    g = g.select("a", "b", "shared", "diff_count", (F.col("derived") + F.col("gone")).alias("derived"), "value_params", "type_params", "hard", (F.col("cost") - F.col("gone") * (WEIGHTS["type-name"] - WEIGHTS["derived-type"])).alias("cost"))
    ratio = lambda s, d: F.when(s + d == 0, 1.0).otherwise(F.round(s / (s + d), 6))
    s, d = F.col("shared"), F.col("diff_count")
    return g.withColumn("similarity", ratio(s, d)).withColumn("effective", ratio(s + F.col("derived"), d - F.col("derived")))


def unifiable(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Scores with whether the pair differs in names and types only and is alike enough."""
    return scores.withColumn("unifiable", (F.col("effective") >= threshold) & (F.col("hard") == 0))


def template(diffs: DataFrame) -> DataFrame:
    """(a, b, path, text, review): side a with roots as ``?T`` and their number, literals and operators flagged."""
    t = diffs.where("right IS NOT NULL OR category = 'shared'")
    at = F.array_position(F.transform("roots", lambda p: p["left"]), F.col("left"))
    text = F.when(F.col("category") == "type-name", F.concat(F.lit("?T"), (at - 1).cast("string"))).otherwise(F.col("left"))
    return t.select("a", "b", "path", text.alias("text"), F.col("category").isin("literal-value", "operator", "structural").alias("review"))
