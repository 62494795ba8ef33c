"""Mixing sources to target weights by Pareto order sampling (operator 3).

Sources get integer shares of a fixed number of documents by largest remainder.
Inside a source a document expects ``share * m / sum(m)`` copies, m being its
integer preference.  The whole part of that are certain copies.  The fractional
parts p are inclusion probabilities of a fixed-size sample: documents are ranked
by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the
least ones are taken, so that a source has exactly its share.

u comes from an MD5 of the doc_id (of the row's content without one), so the sample is repeatable; rows of one doc_id share their draw.  All counts are
exact integers.  The rank of the last one taken is found without sorting a
source: a histogram over ``BINS`` bins of the rank variable names the bin in which
each source's cut lies, and only that bin's rows are ordered.  Texts are never
shuffled but for those few rows.

Default weights are proportional to the square root of a source's document
count, which lifts small sources; preferences by language are a parameter.

Defined results: a null source is a source of its own; a source named in the
weights but absent gives nothing, and its share goes to the others; a source without a weight gets none. Equal ranks
go by doc_id (nulls last), then by the row's content; fully equal rows are
interchangeable.  An empty table gives an empty result.  A preference below 1 or
null counts as 1.  Null, empty and very long texts are rows like others; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import checkpointed, documents, fresh, row_key, small_side

SEED = "mix-1"
BINS = 1 << 14
#: Integer preference of a document by its language; others count as 1.
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 2}
_TWO52 = 1 << 52


def preference(column: str = "lang", languages: dict[str, int] = LANGUAGES) -> Column:
    c = F.lit(1)
    for k, v in languages.items():
        c = F.when(F.col(f"`{column}`") == k, F.lit(v)).otherwise(c)
    return c.cast("long")


def shares(counts: DataFrame, size: int | None = None, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, n, m, share) from (source, n, m): documents, sum of preferences, and documents wanted, by largest remainder.

    ``size`` is the number wanted in all, as many as there are if None.
    """
    if weights is None:
        w = F.floor(F.sqrt(F.col("n").cast("double")) * 1_000_000)
    else:
        w = F.lit(0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(round(v * 1_000_000_000))).otherwise(w)
    big = "decimal(38,0)"
    all_ = Window.partitionBy(F.lit(0))  # a row for each source
    t = counts.withColumn("w", w.cast("decimal(20,0)")).withColumn("ww", F.sum("w").over(all_).cast("decimal(20,0)"))
    t = t.withColumn("size", (F.sum("n").over(all_) if size is None else F.lit(size)).cast("decimal(18,0)"))
    quota = F.col("size") * F.col("w")
    t = t.where("ww > 0").withColumn("base", F.expr("(size * w) div ww")).withColumn("rem", (quota % F.col("ww")).cast(big))
    t = t.withColumn("left", F.col("size").cast("long") - F.sum("base").over(all_)).withColumn("nth", F.row_number().over(all_.orderBy(F.desc("rem"), F.col("source").asc_nulls_last())))
    return t.select("source", "n", "m", (F.col("base") + (F.col("nth") <= F.col("left")).cast("long")).alias("share"))


def _ranked(docs: DataFrame, prefer: Column, names: dict[str, str], plan: DataFrame) -> DataFrame:
    """``docs`` with its certain copies, whether it takes part in the sample, and its rank variable."""
    n = names
    p = small_side(plan.select(F.col("source").alias(n["src"]), F.col("m").alias(n["m"]), F.col("share").alias(n["share"])))
    t = docs.withColumn(n["w"], prefer)
    t = t.join(p, F.col("source").eqNullSafe(F.col(n["src"])))
    want = F.col(n["share"]).cast("decimal(19,0)") * F.col(n["w"]).cast("decimal(18,0)")
    t = t.withColumn(n["q"], want)
    t = t.withColumn(n["whole"], F.expr(f"{n['q']} div {n['m']}").cast("long")).withColumn(n["rem"], (F.col(n["q"]) % F.col(n["m"])).cast("double"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), row_key(docs, 3).cast("string")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), key)), 1, 13), 16, 10).cast("double")
    m = F.col(n["m"]).cast("double")
    odds = (u / (F.lit(float(_TWO52)) - u)) * ((m - F.col(n["rem"])) / F.col(n["rem"]))
    return t.withColumn(n["q"], F.when(F.col(n["rem"]) > 0, odds))


def copies(docs: DataFrame, size: int | None = None, weights: dict | None = None, prefer: Column | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the number of copies of each row as a last column, and that column's name; rows without a copy are left out."""
    if prefer is None:
        prefer = preference() if "lang" in docs.columns else F.lit(1).cast("long")
    prefer = F.greatest(F.coalesce(prefer.cast("long"), F.lit(1)), F.lit(1))
    n = {k: fresh(k) for k in ("src", "m", "share", "w", "q", "whole", "rem", "bin", "cut", "take", "nth", "of")}
    base = docs.select("source", prefer.alias("m")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    plan = checkpointed(shares(base, size, weights))
    t = _ranked(docs, prefer, n, plan).withColumn(n["bin"], F.floor(F.col(n["q"]) / (F.col(n["q"]) + 1) * BINS))
    hist = t.groupBy(F.col(n["src"]).alias("source"), F.col(n["bin"]).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum(n["whole"]).alias("whole"), F.first(n["share"]).alias("share"))
    by = Window.partitionBy("source")
    hist = hist.withColumn("k", F.col("share") - F.sum("whole").over(by)).where("bin IS NOT NULL")
    hist = hist.withColumn("before", F.coalesce(F.sum("c").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = checkpointed(hist.where("before < k AND before + c >= k").select(F.col("source").alias(n["of"]), F.col("bin").alias(n["cut"]), (F.col("k") - F.col("before")).alias(n["take"])))
    t = t.join(small_side(cut), F.col(n["src"]).eqNullSafe(F.col(n["of"])), "left")
    at = F.col(n["bin"]) == F.col(n["cut"])
    sure = t.where(~F.coalesce(at, F.lit(False))).withColumn(n["nth"], F.col(n["whole"]) + F.coalesce((F.col(n["bin"]) < F.col(n["cut"])).cast("long"), F.lit(0)))
    order = Window.partitionBy(n["src"]).orderBy(n["q"], F.col("doc_id").asc_nulls_last(), row_key(docs, 3))
    edge = t.where(at).withColumn(n["nth"], F.row_number().over(order)).withColumn(n["nth"], F.col(n["whole"]) + (F.col(n["nth"]) <= F.col(n["take"])).cast("long"))
    keep = [*[F.col(f"`{c}`") for c in docs.columns], F.col(n["nth"])]
    return sure.select(*keep).unionByName(edge.select(*keep)).where(F.col(n["nth"]) > 0), n["nth"]


def mixed(docs: DataFrame, size: int | None = None, weights: dict | None = None, prefer: Column | None = None) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it has copies; columns as they are."""
    out, n = copies(docs, size, weights, prefer)
    each = fresh("each")
    return out.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, copies) of every document that the mixture holds."""
    out, n = copies(documents(spark, sf_dir).select("doc_id", "source", "lang"), None, None, None)
    return out.select("doc_id", "source", F.col(n).alias("copies"))


_ORACLE = f"""
WITH d AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS m FROM documents),
c AS (SELECT source, count(*) AS n, CAST(sum(m) AS BIGINT) AS ms, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000000) AS BIGINT) AS w FROM d GROUP BY source),
t AS (SELECT *, sum(w) OVER () AS ww, sum(n) OVER () AS size FROM c),
q AS (SELECT *, (size * w) // ww AS base, (size * w) % ww AS rem FROM t),
s AS (SELECT source, ms, CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, source NULLS LAST) <= size - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM q),
e AS (SELECT d.doc_id, d.source, s.share, (s.share * d.m) // s.ms AS whole, CAST((s.share * d.m) % s.ms AS DOUBLE) AS rem, CAST(s.ms AS DOUBLE) AS ms,
      CAST(CAST('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13) AS BIGINT) AS DOUBLE) AS u
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (SELECT *, CASE WHEN rem > 0 THEN (u / ({float(_TWO52)!r}::DOUBLE - u)) * ((ms - rem) / rem) END AS odds, share - sum(whole) OVER (PARTITION BY source) AS k FROM e),
f AS (SELECT *, CASE WHEN odds IS NOT NULL AND row_number() OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id) <= k THEN 1 ELSE 0 END AS extra FROM r)
SELECT doc_id, source, CAST(whole + extra AS BIGINT) AS copies FROM f WHERE whole + extra > 0
"""
ORACLES = {"op3_mixing": _ORACLE}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mixing": op3_mixing}
