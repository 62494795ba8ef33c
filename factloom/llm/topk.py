"""Exact top-k search by a three-phase uniform threshold (operator 8).

Every row of a query table is a query.  Its score for a document is the sum over
its distinct words of an integer BM25 weight, so a query of m words adds up m
score lists, one of each word; every task holds the part of the lists that its documents have.

1. Each task gathers the K best entries of its part of every list, and the K best of each whole list name documents.
   These documents' scores are completed; the K-th greatest of a query is a lower bound L of its true K-th score.
2. A cutoff is sent out.  Were it L / m, a document without an entry of at least that would score below L.  The words
   of the r smallest greatest entries, R in sum, can add no more than R, so (L - R) / (m - r) is as safe a cutoff for the
   lists of the other m - r words; the r that makes it greatest is taken.  Entries of at least the cutoff are collected.
3. The scores of the documents that have one are completed exactly.  All entries of a document lie together, so this takes
   no exchange: a task sends on the K best complete scores of each query that reach L.

Weights are integers, so sums don't depend on their order.  Equal scores are
ranked by doc_id, then by row.  Words are runs of ASCII letters or digits or of
other characters beyond ASCII, in lower case.

The one scan of the texts is a narrow map that keeps each document's query words, written as Parquet in the shared folder.
Queries are sent as sorted arrays of their words, in blocks of about ``SENT_WORDS`` words; each block has a scan of its own.
Document frequencies and the mean length come from all documents.

Defined results: a text is read whole, however long; an empty table of documents or queries gives no rows, and columns other than
``doc_id``, ``text`` and the query's key are ignored.  A null or empty query has no results, and a document without a common word
is never one, so a query may have fewer than K.  Null and empty documents score nothing but
count as documents.  Repeated documents are results each; repeated queries are answered each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import pieces, relax, words
from ._util import checkpointed, documents, written

K = 10
K1, B = 1.2, 0.75
SCALE = 1000
SENT_WORDS = 200_000
#: (document, query) entries that a task looks at together, about.
STEP = 1 << 20


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, item, word) of the distinct words of each query."""
    for b in batches:
        h, _, _, first = words(b["text"].fill_null(""))
        q = np.repeat(np.arange(b.num_rows), np.diff(first))
        pair = np.unique(np.rec.fromarrays([q, h.view(np.int64)]))
        at = pa.array(pair["f0"])
        yield pa.RecordBatch.from_arrays([b["qid"].take(at), b["item"].take(at), pa.array(pair["f1"])], ["qid", "item", "word"])


def _scan(wanted: np.ndarray) -> Callable:
    """(rid, doc_id, len, docs, words, tfs): the words in ``wanted`` of each document that has any; and a row with ``docs`` and the words in ``len`` of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "len", "docs", "words", "tfs"]
        for b in batches:
            for i, part in pieces(b["text"].fill_null(""), 4 << 20):
                h, _, _, first = words(part)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, b["doc_id"].type), pa.array([len(h)]), pa.array([len(part)]), pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32()))], names)
                w = h.view(np.int64)
                at = np.searchsorted(wanted, w)
                at[at == len(wanted)] = 0
                hit = wanted[at] == w
                key, tf = np.unique(np.repeat(np.arange(len(part)), n)[hit] * len(wanted) + at[hit], return_counts=True)
                row, code = np.divmod(key, len(wanted))
                some, start = np.unique(row, return_index=True)
                off = pa.array(np.append(start, len(row)), pa.int32())
                at = pa.array(some + i)
                yield pa.RecordBatch.from_arrays(
                    [b["rid"].take(at), b["doc_id"].take(at), pa.array(n[some].astype(np.int64)), pa.nulls(len(some), pa.int64()), pa.ListArray.from_arrays(off, pa.array(wanted[code])), pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32)))], names
                )
            relax()

    return run


@dataclass
class Lists:
    """What is sent of a block of queries: its words, their weights in general, and the queries of each word."""

    wanted: np.ndarray
    idf: np.ndarray
    mean: float
    first: np.ndarray  #: where each word's queries begin
    query: np.ndarray  #: queries, by word
    n: int  #: of queries

    def entries(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, weight) of a batch of documents."""
        lists = b["words"]
        size = np.asarray(lists.value_lengths(), np.int64)
        row = np.repeat(np.arange(b.num_rows), size)
        code = np.searchsorted(self.wanted, lists.flatten().to_numpy(zero_copy_only=False))
        tf = b["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        length = b["len"].to_numpy(zero_copy_only=False)[row]
        weight = self.idf[code] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))) * SCALE
        return row, code, np.floor(weight + 0.5).astype(np.int64)

    def steps(self, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, entries of queries, weights): every query's entries of some rows at a time, as places in ``query``."""
        row, code, weight = self.entries(b)
        n = self.first[code + 1] - self.first[code]
        cum = np.concatenate([[0], np.cumsum(n)])
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(cum, cum[lo] + STEP)) - 1)
            hi = int(np.searchsorted(row, row[hi - 1], "right"))  # whole rows
            m = n[lo:hi]
            at = np.repeat(self.first[code[lo:hi]] - (cum[lo:hi] - cum[lo]), m) + np.arange(cum[hi] - cum[lo])
            yield row[lo], np.repeat(row[lo:hi], m), at, np.repeat(weight[lo:hi], m)
            lo = hi


def _best(keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first ``k`` of each value of the first key in the order of all keys."""
    order = np.lexsort(keys[::-1])
    g = keys[0][order]
    nth = np.arange(len(g)) - np.searchsorted(g, g)
    return order[nth < k]


def _gather(held, k: int) -> Callable:
    """(word, rid, weight): the k best entries of every word in a batch; phase 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held.value
        for b in batches:
            row, code, weight = lists.entries(b)
            at = _best([code, -weight], k)
            yield pa.RecordBatch.from_arrays([pa.array(code[at]), b["rid"].take(pa.array(row[at])), pa.array(weight[at])], ["word", "rid", "weight"])

    return run


def _complete(held, sent, k: int) -> Callable:
    """(q, score): the k best scores of each query among the documents ``sent`` (sorted) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, rids = held.value, sent.value
        for b in batches:
            rid = b["rid"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(rids, rid)
            at[at == len(rids)] = 0
            b = b.filter(pa.array(rids[at] == rid))
            for low, row, at, weight in lists.steps(b):
                key, place = np.unique((row - low) * lists.n + lists.query[at], return_inverse=True)
                score = np.bincount(place.ravel(), weight).astype(np.int64)
                q = key % lists.n
                top = _best([q, -score], k)
                yield pa.RecordBatch.from_arrays([pa.array(q[top]), pa.array(score[top])], ["q", "score"])

    return run


def _collect(held, cut, k: int) -> Callable:
    """(q, rid, doc_id, score): the k best documents of each query in a batch that reach its bound; phases 2 and 3.

    ``cut`` has, by query, need and parts (an entry passes if weight * parts >= need) and the bound, and, by place in the lists, whether the entry's word is under the cutoff.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, (need, parts, bound, inner) = held.value, cut.value
        for b in batches:
            for low, row, at, weight in lists.steps(b):
                q = lists.query[at]
                key = (row - low) * lists.n + q
                some = np.unique(key[inner[at] & (weight * parts[q] >= need[q])])
                if not len(some):
                    continue
                place = np.searchsorted(some, key)
                place[place == len(some)] = 0
                ok = some[place] == key
                score = np.bincount(place[ok], weight[ok], len(some)).astype(np.int64)
                good = score >= np.maximum(bound[some % lists.n], 1)
                some, score = some[good], score[good]
                q = some % lists.n
                docs = pa.array(some // lists.n + low)
                out = pa.table({"q": pa.array(q), "rid": b["rid"].take(docs), "doc_id": b["doc_id"].take(docs), "score": pa.array(score)})
                order = pa.compute.sort_indices(out, [("q", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("rid", "ascending")])
                g = q[order.to_numpy()]
                yield from out.take(order.filter(pa.array(np.arange(len(g)) - np.searchsorted(g, g) < k))).combine_chunks().to_batches()

    return run


def _answers(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score) of one block of queries (qid, word)."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    table = terms.select("qid", "word").toArrow()
    qids, query = np.unique(table["qid"].to_numpy(), return_inverse=True)
    wanted, code = np.unique(table["word"].to_numpy(), return_inverse=True)
    query, code = query.ravel(), code.ravel()
    if not len(wanted):
        return spark.createDataFrame([], f"qid long, rank int, doc_id {key}, score long")
    order = np.lexsort((query, code))
    query, code = query[order], code[order]
    post = written(docs.mapInArrow(_scan(wanted), f"rid long, doc_id {key}, len long, docs long, words array<long>, tfs array<int>"))
    size = post.where("docs IS NOT NULL").agg(F.sum("docs"), F.sum("len")).first()
    n, mean = size[0] or 0, max(1.0, (size[1] or 0) / max(1, size[0] or 0))
    post = post.where("docs IS NULL")
    counts = post.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(wanted))
    df[np.searchsorted(wanted, counts["word"].to_numpy())] = counts["df"].to_numpy()
    held = spark.sparkContext.broadcast(Lists(wanted, np.log((n - df + 0.5) / (df + 0.5) + 1.0), mean, np.searchsorted(code, np.arange(len(wanted) + 1)), query, len(qids)))

    # 1: the k best entries of every list; the k-th best score that the documents in them have (0 if a query has fewer)
    best = post.mapInArrow(_gather(held, k), "word long, rid long, weight long")
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("weight"), "rid"))).where(F.col("nth") <= k).toArrow()
    rids = np.unique(best["rid"].to_numpy())
    most = np.zeros(len(wanted), np.int64)
    np.maximum.at(most, best["word"].to_numpy(), best["weight"].to_numpy())
    bound = np.zeros(len(qids), np.int64)
    if len(rids):
        scores = post.mapInArrow(_complete(held, spark.sparkContext.broadcast(rids), k), "q long, score long")
        scores = scores.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") == k).toArrow()
        bound[scores["q"].to_numpy()] = scores["score"].to_numpy()
    # 2: the cutoff; a query's words by their greatest entries, of which the first r are left out
    order = np.lexsort((code, most[code], query))
    start = np.searchsorted(query[order], np.arange(len(qids)))
    m = np.diff(np.append(start, len(order)))
    r = np.arange(len(order)) - np.repeat(start, m)
    top = most[code[order]]
    cum = np.cumsum(top) - top
    rest = cum - np.repeat(cum[start], m)
    level = (np.repeat(bound, m) - rest) / (np.repeat(m, m) - r)
    choice = _best([query[order], -level], 1)
    need, parts = bound - rest[choice], m - r[choice]
    inner = np.zeros(len(order), bool)
    inner[order] = r >= np.repeat(r[choice], m)
    # 3: complete scores of the documents with an entry over it
    cut = spark.sparkContext.broadcast((need, parts, bound, inner))
    found = post.mapInArrow(_collect(held, cut, k), f"q long, rid long, doc_id {key}, score long")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rid")
    names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(qids))), "qid": pa.array(qids)}))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).join(names, "q").select("qid", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, item: str = "item_id", k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of every row of ``queries`` (item, text)."""
    item_type = queries.schema[item].dataType.simpleString()
    q = queries.select(F.monotonically_increasing_id().alias("qid"), F.col(f"`{item}`").alias("item"), F.col("text").cast("string").alias("text"))
    q = checkpointed(q.mapInArrow(_terms, f"qid long, item {item_type}, word long"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil(q.count() / SENT_WORDS))
    parts = [_answers(rows, q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i), k) for i in range(blocks)]
    items = q.select("qid", "item").distinct()
    return reduce(DataFrame.unionByName, parts).join(items, "qid").select(F.col("item").alias(item), "rank", "doc_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10ffff}]+')"
ORACLES = {
    "op8_topk": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
st AS (SELECT count(*) AS n, greatest(1.0::DOUBLE, CAST(sum(len(ws)) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS mean FROM d),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS word FROM benchmark),
p AS (SELECT doc_id, word, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS word FROM d) GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM p GROUP BY word),
w AS (SELECT p.doc_id, p.word, CAST(round(ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE) + 1.0::DOUBLE) * (p.tf * {K1 + 1!r}::DOUBLE / (p.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * p.n / st.mean))) * {SCALE}) AS BIGINT) AS weight FROM p JOIN df USING (word), st),
s AS (SELECT q.item_id, w.doc_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (word) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_topk": op8_topk}
