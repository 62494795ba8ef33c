"""Fixpoints of DataFrames: rounds cut their lineage with checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds whose rows are kept apart before they are written together.
PARTS = 16


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once where ``spark.checkpoint.dir`` says; a local session without it uses a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set")
            folder = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(folder)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # the written plan would keep constraints on columns it doesn't have, and later unions fail on them
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, before)


def placed(df: DataFrame, *on: str, distinct: bool = False) -> DataFrame:
    """``df`` checkpointed where its rows of equal ``on`` lie together; what joins or groups by these later needs no shuffle of it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, *on)
    return kept(rows.distinct() if distinct else rows)


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with its partitioning, which an adaptive plan wouldn't tell."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpointed(df.select("*"))  # planned anew
    finally:
        conf.set(name, before)


def minus(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows that ``seen`` (same columns) lacks, NULLs being equal."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in rows.columns]
    return rows.alias("r").join(seen.select(*rows.columns).alias("s"), reduce(lambda a, b: a & b, same), "left_anti")


def grow(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None, on: str | None = None) -> DataFrame:
    """All rows reachable from ``seed`` by ``step``, semi-naively: a round extends only the rows the last one added.

    ``limit`` bounds the rounds (fuel).  Rows are compared as wholes; ends when a round adds nothing.  A round writes its new
    rows only; what was found before is written again once in PARTS rounds.  With ``on``, the column by which ``step`` joins, rows are placed by it: a round then shuffles
    its new rows only, and neither those found before nor edges placed by that column.
    """
    if on is not None:
        return _grow_placed(seed, step, limit, on)
    front, rounds = checkpointed(seed.distinct()), 0
    found = [front]
    while limit is None or rounds < limit:
        seen = reduce(DataFrame.unionByName, found)
        front = checkpointed(minus(step(front).select(*seen.columns).distinct(), seen))
        if front.isEmpty():
            break
        found.append(front)
        if len(found) > PARTS:
            found = [checkpointed(reduce(DataFrame.unionByName, found))]
        rounds += 1
    return reduce(DataFrame.unionByName, found)


def _grow_placed(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None, on: str) -> DataFrame:
    names, n, rounds = seed.columns, int(seed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    front = placed(seed.distinct(), on)
    found = [front]
    while limit is None or rounds < limit:
        new = step(front).select(*names).repartition(n, on).withColumn("_new", F.lit(True))
        old = [f.withColumn("_new", F.lit(False)) for f in found]
        both = reduce(DataFrame.unionByName, [new, *old])
        front = kept(both.groupBy(*names).agg(F.min("_new").alias("_new")).where("_new").select(*names))
        if front.isEmpty():
            break
        found.append(front)
        if len(found) > PARTS:
            found = [kept(reduce(DataFrame.unionByName, found))]
        rounds += 1
    return reduce(DataFrame.unionByName, found)


def settle(state: DataFrame, keys: list[str], value: str, step: Callable[[DataFrame], DataFrame], best: Callable = F.min, on: str | None = None) -> DataFrame:
    """Least solution of ``state[keys] = best(state, step(state))`` for an idempotent ``best`` (min, max, bit_or).

    Rows are placed by ``on``, the key by which ``step`` joins (the first one without it).  ``step`` gets the rows that the last round made better; a round
    shuffles what comes of them and writes what is better still, no more.
    """
    on = on or keys[0]
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = kept(state.select(*keys, value).repartition(n, on).groupBy(*keys).agg(best(value).alias(value)))
    found = [front]
    while True:
        new = step(front).select(*keys, value).repartition(n, on).withColumn("_new", F.lit(True))
        both = reduce(DataFrame.unionByName, [new, *[f.withColumn("_new", F.lit(False)) for f in found]])
        g = both.groupBy(*keys).agg(best(value).alias(value), best(F.when(~F.col("_new"), F.col(value))).alias("_was"), F.min("_new").alias("_first"))
        front = kept(g.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_was"))).select(*keys, value))
        if front.isEmpty():
            break
        found.append(front)
        if len(found) > PARTS:
            found = [kept(reduce(DataFrame.unionByName, found).groupBy(*keys).agg(best(value).alias(value)))]
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy(*keys).agg(best(value).alias(value))


#: Names of at most this many rows are broadcast.
BOUNDED = 100_000


def numbered(names: DataFrame, column: str) -> DataFrame:
    """(``column``, word, bit): each name (other than NULL) has a bit of its own in words of 64, so that a set of names is a few masks."""
    n = checkpointed(names.select(column).where(F.col(column).isNotNull()).distinct())
    size = n.count()
    ids = checkpointed(n.coalesce(1 + size // 1_000_000).withColumn("_i", F.monotonically_increasing_id()))
    out = ids.select(column, F.shiftright("_i", 6).alias("word"), F.expr("shiftleft(1L, cast(_i & 63 AS INT))").alias("bit"))
    return F.broadcast(out) if size <= BOUNDED else out


def named(masks: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows with (word, mask) as one row for each name of the mask."""
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: F.col("mask").bitwiseAND(b) != 0)
    return masks.withColumn("bit", F.explode(bits)).join(ids, ["word", "bit"]).drop("word", "bit", "mask")
