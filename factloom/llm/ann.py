"""Approximate nearest neighbours by stable projections and a kd-tree (operator 5).

Vectors are projected to ``DIM`` Gaussian (2-stable) coordinates.  If o is at
distance d of a query, their projections' squared distance is d**2 times a
chi-square variable of DIM degrees.  A kd-tree over the projections has its leaves
as cells of the cluster.  A query goes through the vectors by the projected
distance r, verifies them with true distances, and stops as soon as
``P(chi2 <= r**2 / d_k**2) >= CONFIDENCE`` for its K-th best true distance d_k: a
nearer vector farther off in projection is then unlikely.

That runs in rounds: its own cell, then the next 3, 12, 48, ... cells by their projected distance, until for the next one the
test holds; each query stops on its own.  In a cell the nearest by projection come first and improve d_k, and of the others only those are
verified for which the test doesn't hold yet.  A round is one shuffle of the queries that still search to the cells they visit;
the index is placed by cells once.  Cells of over ``BLOCK`` vectors are split in blocks by a hash of the row.
Of equal vectors in a batch only the first K + 1 are indexed: no query can have more of them among its neighbours.

Splits come from a hash sample of at most ``SPLIT_SAMPLE`` projections; they say where
cells end and never which vectors are looked at.

Defined results: every row is indexed; neighbours are other rows (equal vectors and repeated rows too), by
distance, then vec_id (nulls last), then row; with K or fewer others all are given.  A null vector, one with a null
or not finite entry, or of another length than most is no query and nobody's neighbour.  An empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import mix
from ._util import checkpointed, documents, written

K = 10
DIM = 8
CONFIDENCE = 0.9
CELL = 256
MOST_CELLS = 1 << 16
#: Vectors of a cell that one task looks at.
BLOCK = 1 << 16
#: By how much a round widens the search.
WIDER = 4
SPLIT_SAMPLE = 100_000
SEED = 20240711


def chi2_cdf(x: float, m: int = DIM) -> float:
    """Distribution of chi-square with an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def stop_ratio(confidence: float = CONFIDENCE, m: int = DIM) -> float:
    """The r**2 / d_k**2 from which the stopping test holds."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < confidence else (lo, mid)
    return hi


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIM)).astype(np.float32)


class Tree:
    """kd-tree of ``2**levels`` cells: split values in level order, and the box of each cell."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis = np.zeros((1 << levels) - 1, np.int32)
        self.value = np.zeros((1 << levels) - 1, np.float32)
        self.low = np.full((1 << levels, DIM), -np.inf, np.float32)
        self.high = np.full((1 << levels, DIM), np.inf, np.float32)
        self._split(sample, 0, 0, np.full(DIM, -np.inf, np.float32), np.full(DIM, np.inf, np.float32))

    def _split(self, part: np.ndarray, level: int, nth: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.levels:
            self.low[nth], self.high[nth] = low, high
            return
        at = (1 << level) - 1 + nth
        axis = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
        value = np.median(part[:, axis]).astype(np.float32) if len(part) else np.float32(0)
        self.axis[at], self.value[at] = axis, value
        left = part[:, axis] < value
        h, lo = high.copy(), low.copy()
        h[axis] = min(h[axis], value)
        lo[axis] = max(lo[axis], value)
        self._split(part[left], level + 1, 2 * nth, low, h)
        self._split(part[~left], level + 1, 2 * nth + 1, lo, high)

    def cell(self, x: np.ndarray) -> np.ndarray:
        nth = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(self.levels):
            at = (1 << level) - 1 + nth
            nth = 2 * nth + (x[rows, self.axis[at]] >= self.value[at])
        return nth

    def gap2(self, x: np.ndarray) -> np.ndarray:
        """Squared projected distance of each row to each cell's box."""
        out = np.zeros((len(x), len(self.low)), np.float32)
        for d in range(DIM):
            gap = np.maximum(np.maximum(self.low[:, d] - x[:, d : d + 1], x[:, d : d + 1] - self.high[:, d]), 0)
            out += gap * gap
        return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, 1), np.float32)
    return np.asarray(col.flatten(), np.float32).reshape(len(col), -1)


def _list(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _first(group: np.ndarray, d2: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (d2, at) of each group."""
    order = np.lexsort((at, d2, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (q[i], x[j]), each computed the same way wherever it is."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        d = q[i[lo : lo + (1 << 15)]].astype(np.float64) - x[j[lo : lo + (1 << 15)]]
        out[lo : lo + len(d)] = (d * d).sum(1)
    return out


def nearest(q: np.ndarray, qp: np.ndarray, qrid: np.ndarray, bound: np.ndarray, x: np.ndarray, xp: np.ndarray, xrid: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the k nearest of the rows ``x`` to each query, but for itself; equal distances in the order of rows.

    A row is verified unless the stopping test holds for its projection and the k-th distance so far (``bound``, or the k-th of the first rows here).
    """
    by = np.argsort(xrid)
    got = []
    for lo in range(0, len(q), 128):
        part, pp = q[lo : lo + 128], qp[lo : lo + 128].astype(np.float64)
        r2 = (pp * pp).sum(1)[:, None] - 2 * (pp @ xp.T) + (xp * xp).sum(1, dtype=np.float64)
        at = np.searchsorted(xrid[by], qrid[lo : lo + 128])
        at[at == len(xrid)] = 0
        own = by[at]
        hit = np.flatnonzero(xrid[own] == qrid[lo : lo + 128])
        r2[hit, own[hit]] = np.inf
        limit = bound[lo : lo + 128].copy()
        n = min(4 * k, len(x))
        near = np.argpartition(r2, n - 1, 1)[:, :n]
        i, j = np.repeat(np.arange(len(part)), n), near.ravel()
        d = _distances(part, x, i, j)
        d[~np.isfinite(r2[i, j])] = np.inf
        if n >= k:
            limit = np.minimum(limit, np.partition(d.reshape(-1, n), k - 1, 1)[:, k - 1])
        more = r2 < limit[:, None] * ratio
        more[~np.isfinite(r2)] = False
        more[i, j] = False
        i2, j2 = np.nonzero(more)
        i, j, d = np.concatenate([i, i2]), np.concatenate([j, j2]), np.concatenate([d, _distances(part, x, i2, j2)])
        ok = (d <= limit[i]) & np.isfinite(d)
        i, j, d = i[ok], j[ok], d[ok]
        best = _first(i, d, j, k)
        got.append((i[best] + lo, j[best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _kept(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Whether each row is among the first k + 1 by ``rank`` of the rows with its vector."""
    h = np.ascontiguousarray(x + np.float32(0)).view(np.dtype((np.void, x.shape[1] * 4))).ravel()
    _, group = np.unique(h, return_inverse=True)
    ok = np.zeros(len(x), bool)
    ok[_first(group.ravel(), np.zeros(len(x)), rank, k + 1)] = True
    return ok


def neighbours(vectors: DataFrame, k: int = K, confidence: float = CONFIDENCE, cell: int = CELL, asked: Column | None = None, visits: list | None = None) -> DataFrame:
    """(vec_id, rank, neighbour, distance) of the rows of ``vectors`` (vec_id, embedding) for which ``asked`` holds (all without it), against all rows.

    ``visits`` gets (round, number of queries' visits to cells) for each round.
    """
    spark = vectors.sparkSession
    key = vectors.schema["vec_id"].dataType.simpleString()
    ask = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("x"), ask.alias("ask"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], f"vec_id {key}, rank int, neighbour {key}, distance double")
    size, n = sizes["size"], sizes["count"]
    rows = rows.where(F.size("x") == size)
    g = projection(size)
    levels = min(MOST_CELLS.bit_length() - 1, max(0, math.ceil(math.log2(max(1, n / cell)))))
    sample = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SPLIT_SAMPLE / n)))).select("x").limit(2 * SPLIT_SAMPLE).toArrow()
    tree = Tree(_matrix(sample["x"]) @ g if sample.num_rows else np.zeros((1, DIM), np.float32), levels)
    held = spark.sparkContext.broadcast(tree)
    ratio = stop_ratio(confidence)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "vec_id", "x", "p", "cell", "ask", "kept"]
        for b in batches:
            x = _matrix(b["x"])
            p = (x @ g).astype(np.float32)
            order = pc.sort_indices(pa.table({"v": b["vec_id"], "r": b["rid"]}), [("v", "ascending"), ("r", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays([b["rid"], b["vec_id"], b["x"], _list(p, pa.float32()), pa.array(held.value.cell(p)), b["ask"], pa.array(_kept(x, rank, k))], names)

    placed = written(rows.select("rid", "vec_id", "x", "ask").mapInArrow(place, f"rid long, vec_id {key}, x array<float>, p array<float>, cell long, ask boolean, kept boolean"))
    index = placed.where("kept").drop("kept", "ask")
    count = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    blocks = np.zeros(1 << levels, np.int64)
    blocks[count["cell"].to_numpy()] = -(-count["n"].to_numpy() // BLOCK)
    split = spark.sparkContext.broadcast(blocks)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, rid = b["cell"].to_numpy(), b["rid"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c << 32 | mix(rid.view(np.uint64)).astype(np.int64) % (1 << 31) % split.value[c]), *(b[i] for i in ("rid", "vec_id", "x", "p"))], ["part", "rid", "vec_id", "x", "p"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * size * 5 / (64 << 20)))
    index = checkpointed(index.mapInArrow(block, f"part long, rid long, vec_id {key}, x array<float>, p array<float>").repartition(tasks, "part"))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        """Visiting queries (rid, x, p, bound) against a block's rows."""
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"qrid": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "vec_id": pa.array([], right.schema.field("vec_id").type), "rid": pa.array([], pa.int64())})
        right = right.take(pc.sort_indices(right, [("vec_id", "ascending"), ("rid", "ascending")]))
        qrid = left["rid"].to_numpy()
        i, j, d2 = nearest(_matrix(left["x"]), _matrix(left["p"]), qrid, left["bound"].to_numpy(), _matrix(right["x"]), _matrix(right["p"]), right["rid"].to_numpy(), k, ratio)
        at = pa.array(j)
        return pa.table({"qrid": pa.array(qrid[i]), "d2": pa.array(d2), "vec_id": right["vec_id"].take(at).combine_chunks(), "rid": right["rid"].take(at).combine_chunks()})

    def route(lo: int, hi: int) -> Callable:
        """(part, rid, x, p, bound): the cells from the lo-th to the hi-th by distance that each query visits, as far as the test doesn't stop it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = held.value
            for b in batches:
                for first in range(0, b.num_rows, 256):
                    part = b.slice(first, 256)
                    gap = t.gap2(_matrix(part["p"]))
                    own = part["cell"].to_numpy()
                    gap[np.arange(len(own)), own] = -1.0
                    kth = part["kth"].to_numpy()
                    top = min(hi, gap.shape[1])
                    near = np.argpartition(gap, top - 1, 1)[:, :top] if top < gap.shape[1] else np.tile(np.arange(top), (len(own), 1))
                    near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(gap, near, 1))), 1)[:, lo:]
                    i, j = np.nonzero(np.take_along_axis(gap, near, 1) < kth[:, None] * ratio)
                    c = near[i, j]
                    m = split.value[c]
                    i, c = np.repeat(i, m), np.repeat(c, m)
                    nth = np.arange(len(c)) - np.repeat(np.cumsum(m) - m, m)
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(c << 32 | nth), part["rid"].take(at), part["x"].take(at), part["p"].take(at), pa.array(kth[i])], ["part", "rid", "x", "p", "bound"])

        return run

    queries = placed.where("ask").select("rid", "vec_id", "x", "p", "cell")
    order = Window.partitionBy("qrid").orderBy("d2", F.col("vec_id").asc_nulls_last(), "rid")
    found = spark.createDataFrame([], f"qrid long, d2 double, vec_id {key}, rid long, nth int")
    searching = queries.withColumn("kth", F.lit(float("inf")))
    lo, hi = 0, 1
    while lo < 1 << levels:
        routed = checkpointed(searching.mapInArrow(route(lo, hi), "part long, rid long, x array<float>, p array<float>, bound double"))
        if routed.isEmpty():
            break
        if visits is not None:
            visits.append((len(visits), routed.count()))
        met = routed.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(lambda a, b: verify(a, b), f"qrid long, d2 double, vec_id {key}, rid long")
        every = found.drop("nth").unionByName(met).withColumn("nth", F.row_number().over(order))
        found = checkpointed(every.where(F.col("nth") <= k))
        far = found.where(F.col("nth") == k).select(F.col("qrid").alias("rid"), F.col("d2").alias("kth"))
        searching = queries.join(far, "rid", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
        lo, hi = hi, hi * WIDER
    return found.join(queries.select(F.col("rid").alias("qrid"), F.col("vec_id").alias("id")), "qrid").select(F.col("id").alias("vec_id"), F.col("nth").alias("rank"), F.col("vec_id").alias("neighbour"), F.sqrt("d2").alias("distance"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every embedding whose id is divisible by 50, among all."""
    return neighbours(documents(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_ann": op5_ann}
