"""MinHash near-dedup by a multi-index Hamming join (operator 10).

A document's signature is SLOTS minhashes of its word-bigram set, each cut to 16
bits.  The distance of two signatures is the number of slots that differ; its
expectation is (1 - Jaccard) * SLOTS.  All pairs within RADIUS are found without
comparing all pairs: the slots form CHUNKS chunks, by pigeonhole two signatures
within RADIUS = CHUNKS * (ERRORS + 1) - 1 have a chunk with at most ERRORS
differing slots, and all ways of leaving out ERRORS slots of a chunk are
enumerated as index keys, so the two share a key.  Sharing a key only proposes;
the whole signatures decide.

For deduplication, a bucket of signatures that share a key is not turned into
all its pairs: a search inside it returns edges that connect what is connected,
a number linear in the bucket, however large.  Its work is bounded too: where members share the key and
little else, the pigeonhole holds once more for the rest of the slots (of ten other chunks one has at most SPLIT_ERRORS errors),
so only members that share such a second key are compared.  Buckets of over HOT members are split by second keys over
the cluster.  Buckets with the same members
are searched once, and equal signatures enter once.  Groups are the connected
components of these edges; the document with the least (doc_id, content hash)
stays, null doc_ids last.

Defined results: a null text is never a duplicate; texts without a word (empty
ones too) are duplicates only of the very same text; with a single word, the
word itself is the shingle.  Repeated rows are duplicates and one stays; rows of one doc_id and different texts are different
documents.  Texts are read whole, however long; an empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix, pieces, relax, words
from ._util import checkpointed, documents, fresh, row_key, small_side

CHUNKS, PER_CHUNK, ERRORS = 11, 6, 2
SLOTS = CHUNKS * PER_CHUNK
RADIUS = CHUNKS * (ERRORS + 1) - 1
WIDTH = 2 * SLOTS
_KEPT = list(itertools.combinations(range(PER_CHUNK), PER_CHUNK - ERRORS))
KEYS = CHUNKS * len(_KEPT)
#: Errors of a chunk that second keys allow: RADIUS over the chunks but one.
SPLIT_ERRORS = RADIUS // (CHUNKS - 1)
_SPLIT = list(itertools.combinations(range(PER_CHUNK), PER_CHUNK - SPLIT_ERRORS))
#: Buckets of more members are split over the cluster.
HOT = 1 << 17
#: Scans of the members of a bucket of over SPLIT_FROM that a search takes before it goes by second keys; the edges join the same.
SCANS = 64
SPLIT_FROM = 4096
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, SLOTS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32)


def signatures(texts: pa.Array) -> pa.Array:
    """Signature of each text as 16-bit slots in a binary; null for a null text."""
    out = np.zeros((len(texts), SLOTS), np.uint16)
    for i, part in pieces(texts):
        h, _, _, first = words(part)
        n = np.diff(first)
        with np.errstate(over="ignore"):
            if len(h):
                pair = h.copy()
                pair[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
                last = first[1:][n > 0] - 1
                pair[last] = mix(h[last])  # kept only where a text has a single word
                keep = np.ones(len(h), bool)
                keep[last[n[n > 0] > 1]] = False
                x = (pair[keep] >> np.uint64(32)).astype(np.uint32)
                some = np.flatnonzero(n)
                off = np.concatenate([[0], np.cumsum(np.maximum(n[some] - 1, 1))])[:-1]
                y = np.empty_like(x)
                for k in range(SLOTS):
                    np.multiply(x, _A[k], out=y)
                    np.add(y, _B[k], out=y)
                    low = np.minimum.reduceat(y, off).astype(np.uint64)
                    out[i + some, k] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
            for j in np.flatnonzero(n == 0):
                t = part[j].as_py()
                if t is not None:
                    d = np.frombuffer(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64)
                    out[i + j] = mix(d[0] + mix(d[1] + np.arange(SLOTS, dtype=np.uint64))).astype(np.uint16)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(texts), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pc.if_else(pc.is_valid(texts), flat, pa.scalar(None, pa.binary())) if texts.null_count else flat


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), SLOTS)


def _key(wide: np.ndarray, n: int, chunk: int, kept: tuple[int, ...]) -> np.ndarray:
    """The nth index key of signatures (uint64 slots): the kept slots of a chunk, and n in the last byte."""
    k = np.zeros(len(wide), np.uint64)
    for j in kept:
        k = (k << np.uint64(16)) | wide[:, chunk * PER_CHUNK + j]
    with np.errstate(over="ignore"):
        return mix(mix(k) + np.uint64(n + 1)) & ~np.uint64(255) | np.uint64(n)


def keys(sig: np.ndarray, kept: list[tuple[int, ...]] = _KEPT) -> np.ndarray:
    """The index keys of each signature (rows of ``sig``): every chunk with each choice of slots kept."""
    out = np.empty((len(sig), CHUNKS * len(kept)), np.uint64)
    wide = sig.astype(np.uint64)
    for n, (c, k) in enumerate(itertools.product(range(CHUNKS), kept)):
        out[:, n] = _key(wide, n, c, k)
    return out


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            k = keys(_matrix(part["sig"]))
            ids = np.repeat(part["rid"].to_numpy(zero_copy_only=False), KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(ids)], ["key", "rid"])


def _emit_second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second keys, of the other chunks, of the members (bucket, rid, sig) of buckets that are too large."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            bucket = part["bucket"].to_numpy(zero_copy_only=False).view(np.uint64)
            own = (bucket & np.uint64(255)).astype(np.int64) // len(_KEPT)
            with np.errstate(over="ignore"):
                k = mix(keys(_matrix(part["sig"]), _SPLIT) + mix(bucket)[:, None])
            other = np.repeat(np.arange(CHUNKS), len(_SPLIT))[None] != own[:, None]
            ids = np.repeat(part["rid"].to_numpy(zero_copy_only=False), other.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(k[other].view(np.int64)), pa.array(ids)], ["key", "rid"])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Whole runs of equal first column from sorted batches: (arrays, run offsets) at a time."""
    rest: list[list[pa.Array]] = []  # parts of the last run, which may go on
    for b in batches:
        cols = [b[n] for n in names]
        k = cols[0].to_numpy(zero_copy_only=False)
        if len(k) == 0:
            continue
        off = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        if rest and rest[0][0][0].as_py() == k[0]:
            if len(off) == 1:
                rest.append(cols)
                continue
            rest.append([c.slice(0, off[1]) for c in cols])
            cols, off = [c.slice(off[1]) for c in cols], off[1:] - off[1]
        if rest:
            whole = [pa.concat_arrays(c) for c in zip(*rest, strict=True)]
            yield whole, np.array([0, len(whole[0])])
        if len(off) > 1:
            yield [c.slice(0, off[-1]) for c in cols], off
        rest = [[c.slice(off[-1]) for c in cols]]
    if rest:
        whole = [pa.concat_arrays(c) for c in zip(*rest, strict=True)]
        yield whole, np.array([0, len(whole[0])])


def _buckets(batches: Iterator[pa.RecordBatch], hot: int | None = None) -> Iterator[pa.RecordBatch]:
    """Buckets of two or more signatures: a hash of their members and the members; those of over ``hot`` members in parts, marked and named by their key."""
    names = ["bucket", "members", "hot"]
    for (key, rid), off in _runs(batches, ["key", "rid"]):
        ids = rid.to_numpy(zero_copy_only=False)
        if off[-1] != len(ids):
            off = np.append(off, len(ids))
        n = np.diff(off)
        many = n > 1
        if hot is not None and n.max() > hot:
            for i in np.flatnonzero(n > hot):
                for lo in range(off[i], off[i + 1], hot):
                    part = ids[lo : min(lo + hot, off[i + 1])]
                    yield pa.RecordBatch.from_arrays([key.slice(lo, 1), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part)), pa.array([True])], names)
            many &= n <= hot
        if not many.any():
            continue
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(ids.view(np.uint64)), off[:-1])
            name = mix(total + n.astype(np.uint64))[many].view(np.int64)
        pick = np.repeat(many, n)
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[many])]), pa.int32()), pa.array(ids[pick]))
        yield pa.RecordBatch.from_arrays([pa.array(name), members, pa.array(np.zeros(len(name), bool))], names)


def connect(ids: np.ndarray, sig: np.ndarray, split: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join those members of a bucket that chains of pairs within RADIUS join.

    Each member found is compared with all that aren't found yet.  After SCANS times the bucket's size the rest goes by second keys.
    """
    left, a, b = np.argsort(ids), [], []
    spent, most = 0, SCANS * len(ids) if split and len(ids) > SPLIT_FROM else None
    front: list = []
    while len(left) and (most is None or spent <= most):
        if not front:
            front, left = [(left[0], left[0])], left[1:]
        seed, p = front.pop()
        spent += len(left)
        near = np.concatenate([(sig[left[i : i + 65536]] != sig[p]).sum(1) <= RADIUS for i in range(0, len(left), 65536)]) if len(left) else np.zeros(0, bool)
        hit = left[near]
        if len(hit):
            a.append(np.full(len(hit), ids[seed]))
            b.append(ids[hit])
            left = left[~near]
            front.extend((seed, h) for h in hit)
    if len(left):  # pairs of members that haven't been compared with all others
        some = np.concatenate([np.array([p for _, p in front], np.int64), left])
        x, y = _by_second_keys(ids[some], sig[some])
        a.append(x)
        b.append(y)
    if not a:
        e = np.zeros(0, np.int64)
        return e, e
    return np.concatenate(a), np.concatenate(b)


def _by_second_keys(ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`connect` of members that share a key already: those that share a second one are searched, unless they are joined by then.

    A chunk of which all members share a key says nothing and is left out (the first key's, and one more at most: in nine chunks one
    still has at most SPLIT_ERRORS errors).
    """
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    wide, a, b = sig.astype(np.uint64), [], []
    same = (sig == sig[0]).all(0).reshape(CHUNKS, PER_CHUNK).sum(1) >= PER_CHUNK - SPLIT_ERRORS
    common = np.flatnonzero(same)[: CHUNKS - RADIUS // (SPLIT_ERRORS + 1) - 1]
    for n, (c, kept) in enumerate(itertools.product(range(CHUNKS), _SPLIT)):
        if c in common:
            continue
        k = _key(wide, n, c, kept)
        order = np.argsort(k, kind="stable")
        new = np.flatnonzero(k[order][1:] != k[order][:-1]) + 1
        off = np.concatenate([[0], new, [len(order)]])
        size = np.diff(off)
        two = off[:-1][size == 2]
        x, y = order[two], order[two + 1]
        near = (sig[x] != sig[y]).sum(1) <= RADIUS
        found = [(x[near], y[near])]
        for i in np.flatnonzero(size > 2):
            some = order[off[i] : off[i + 1]]
            if len({root(x) for x in some.tolist()}) > 1:
                found.append(connect(some, sig[some], False))
        for p, q in ((p, q) for x, y in found for p, q in zip(x.tolist(), y.tolist(), strict=True)):
            r, t = root(p), root(q)
            if r != t:
                up[max(r, t)] = min(r, t)
                a.append(ids[p])
                b.append(ids[q])
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, rid, sig), off in _runs(batches, ["bucket", "rid", "sig"]):
        ids, s = rid.to_numpy(zero_copy_only=False), _matrix(sig)
        if off[-1] != len(ids):
            off = np.append(off, len(ids))
        n = np.diff(off)
        two = off[:-1][n == 2]
        ok = two[(s[two] != s[two + 1]).sum(1) <= RADIUS] if len(two) else two
        a, b = [ids[ok]], [ids[ok + 1]]
        for i in np.flatnonzero(n > 2):
            x, y = connect(ids[off[i] : off[i + 1]], s[off[i] : off[i + 1]])
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


_BUCKET = "bucket long, members array<long>, hot boolean"


def _keyed(keyed: DataFrame, hot: int | None) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _buckets(it, hot), _BUCKET)


def buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, rid, sig) of the distinct buckets of two or more of ``sigs`` (rid, sig)."""
    own = sigs.select("rid", "sig")
    found = checkpointed(_keyed(own.mapInArrow(_emit_keys, "key long, rid long"), HOT))
    small = found.where("NOT hot")
    large = found.where("hot")
    if not large.isEmpty():
        members = large.select("bucket", F.explode("members").alias("rid")).join(own, "rid").select("bucket", "rid", "sig")
        small = small.unionByName(_keyed(members.mapInArrow(_emit_second_keys, "key long, rid long"), None))
    members = small.groupBy("bucket").agg(F.first("members").alias("members")).select("bucket", F.explode("members").alias("rid"))
    return members.join(own, "rid")


def edges(sigs: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that connect all of ``sigs`` (rid, sig) within RADIUS of another."""
    return buckets(sigs).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify, "a long, b long").distinct()


def pairs(sigs: DataFrame) -> DataFrame:
    """(a, b, distance): every pair of ``sigs`` (rid, sig) within RADIUS.

    Its size is quadratic in the size of a group; deduplication uses :func:`edges`.
    """

    def all_pairs(batches):
        for (_, rid, sig), off in _runs(batches, ["bucket", "rid", "sig"]):
            ids, s = rid.to_numpy(zero_copy_only=False), _matrix(sig)
            if off[-1] != len(ids):
                off = np.append(off, len(ids))
            for lo, hi in itertools.pairwise(off):
                for i in range(lo, hi - 1):
                    d = (s[i + 1 : hi] != s[i]).sum(1)
                    j = np.flatnonzero(d <= RADIUS)
                    x, y = np.full(len(j), ids[i]), ids[i + 1 + j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d[j].astype(np.int32))], ["a", "b", "distance"])

    return buckets(sigs).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(all_pairs, "a long, b long, distance int").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b); root is the least node of the component.

    Alternating large-star and small-star rounds, each checkpointed, until the edges stay as they are.
    """
    e = checkpointed(links.select("a", "b").where("a <> b"))
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = checkpointed(small.select("a", "b"))
        same = new.count() == e.count() and new.join(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct().toDF("node", "root"))


def signed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, k1, k2, sig) of the rows of ``docs`` whose text isn't null; k1 and k2 hash the row's content."""

    @F.arrow_udf("binary")
    def signature(texts: pa.Array) -> pa.Array:
        out = signatures(texts)
        relax()
        return out

    k1, k2 = row_key(docs, 1), row_key(docs, 2)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id"), k1.alias("k1"), k2.alias("k2"), signature("text").alias("sig"))
    return checkpointed(rows.withColumn("rid", F.monotonically_increasing_id()))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, keep_doc_id, keep_k1, keep_k2): each row of a group but the one that stays, with that one."""
    rows = signed(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2", "rid")
    same = checkpointed(rows.groupBy("sig").agg(F.min(rank).alias("best"), F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")))
    root = components(edges(same.select("rid", "sig")))
    # signatures alone in their group, with one row, need nothing more
    group = checkpointed(same.join(root.withColumnRenamed("node", "rid"), "rid", "left").where("n > 1 OR root IS NOT NULL").select("sig", "best", F.coalesce("root", "rid").alias("root")))
    best = group.groupBy("root").agg(F.min("best").alias("keep"))
    kept = group.select("sig", "root").join(best, "root").select("sig", "keep")
    return rows.join(kept, "sig").where("rid <> keep.rid").select("doc_id", "k1", "k2", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.k1").alias("keep_k1"), F.col("keep.k2").alias("keep_k2"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; columns as they are."""
    gone = checkpointed(duplicates(docs).select("k1", "k2", "keep_k1", "keep_k2"))
    stay = gone.select(F.col("keep_k1").alias("k1"), F.col("keep_k2").alias("k2"))
    k1, k2 = fresh("k"), fresh("k")
    named = lambda df: df.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    drop = named(gone.select("k1", "k2").join(stay, ["k1", "k2"], "left_anti"))
    again = named(gone.select("k1", "k2").where("k1 = keep_k1 AND k2 = keep_k2"))  # whole rows that repeat
    out = docs.withColumn(k1, row_key(docs, 1)).withColumn(k2, row_key(docs, 2))
    out = out.join(small_side(checkpointed(drop)), [k1, k2], "left_anti")
    again = checkpointed(again)
    if not again.isEmpty():
        again = small_side(again)
        out = out.join(again, [k1, k2], "left_anti").unionByName(out.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*out.columns))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of) of every document that goes."""
    return duplicates(documents(spark, sf_dir)).select("doc_id", F.col("keep_doc_id").alias("duplicate_of"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_near_dedup": op10_near_dedup}
