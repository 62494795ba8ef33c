"""Toxicity: subword-bag embeddings averaged into a linear softmax (operator 6).

Every word is the mean of the vectors of its hashed character n-grams, every
window of ``WINDOW`` words the mean of its words, and a linear softmax over that
mean gives the probability of the toxic class.  Vectors and softmax are trained
jointly (L-BFGS with weight decay, numpy) on windows of labelled documents.  A label belongs to a
document and not to its windows, so training starts from log ratios of document
frequency and goes on, round by round, with the windows of toxic documents that
the model finds more toxic than nearly all clean ones, against the worst windows of
every clean document.  A fifth of each class is held out: it chooses among the trained rounds, and the threshold.

Scoring covers the whole text: a document's score is its most toxic window.
The logit is linear in the words, so each distinct word is scored once and a
window is a difference of prefix sums.  Misspellings that training never saw
share most n-grams with their originals.

Defined results: a null, empty or word-less text scores 0 and is never toxic; a
labels table without both classes, or none, gives no model and nothing is
toxic; repeated labels of a document count once, as toxic if any is; labels that
are null are left out.  Repeated rows each get the same score; of equally toxic windows the score is that of all.  A text is
scored whole, however long; an empty table gives no rows.  Scoring keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix, pieces, raw, relax, words
from ._util import documents, fresh

BUCKETS, DIM, WINDOW, STRIDE = 1 << 18, 2, 8, 4
NGRAMS = (3, 4, 5)
#: N-grams are learnt if at least so many documents of the sample have them.
MIN_DOCS = 3
DECAY, STEPS = 2e-5, 15
#: Bound of the training sample, per class; labels are taken in the order of a hash of doc_id.
TRAIN_PER_CLASS = 2000
ROUNDS = 3
#: Documents of each class that are taken to have any n-gram when training starts.
PRIOR = 5.0
#: A window of a toxic document counts as toxic if it scores over this share of the clean documents' worst windows.
SURE = 0.97


@dataclass
class Model:
    grams: np.ndarray  #: contribution of each n-gram bucket to the toxic logit
    bias: float
    threshold: float


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word with its boundary marks, and where each word's begin (words + 1)."""
    if len(start) == 0:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    parts = [_some_grams(data, start[i : i + step], end[i : i + step]) for i in range(0, len(start), step)]
    off, base = [np.zeros(1, np.int64)], 0
    for g, o in parts:
        off.append(o[1:] + base)
        base += len(g)
    return np.concatenate([g for g, _ in parts]), np.concatenate(off)


def _some_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = end - start + 2
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size)
    src = np.repeat(start, size) + at - 1
    edge = (at == 0) | (at == np.repeat(size, size) - 1)
    chars = np.where(edge, np.uint64(1), data[np.clip(src, 0, len(data) - 1)].astype(np.uint64) + np.uint64(2))
    left = np.repeat(off[1:], size) - np.arange(off[-1])
    word = np.repeat(np.arange(len(start)), size)
    got_h, got_w = [], []
    with np.errstate(over="ignore"):
        h = chars.copy()
        for n in range(2, max(NGRAMS) + 1):
            h = h[: len(h) - 1] * np.uint64(1_000_003) + chars[n - 1 :]
            if n in NGRAMS:
                ok = left[: len(h)] >= n
                got_h.append((mix(h[ok] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
                got_w.append(word[: len(h)][ok])
    # a word of one byte has three characters with its marks, so every word has an n-gram
    w, g = np.concatenate(got_w), np.concatenate(got_h)
    order = np.argsort(w, kind="stable")
    return g[order], np.searchsorted(w[order], np.arange(len(start) + 1))


def _mean(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean over the segments [off[i], off[i + 1]), none of them empty."""
    n = np.diff(off)
    return np.add.reduceat(values, off[:-1], axis=0) / (n if values.ndim == 1 else n[:, None])


def _minimise(fun, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``fun`` gives a loss and its gradient."""
    f, g = fun(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(steps):
        d, alpha = -g, []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            alpha.append((s @ d) / (s @ y))
            d = d - alpha[-1] * y
        d *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1]) if s_list else 1 / max(1e-12, np.abs(g).max())
        for s, y, al in zip(s_list, y_list, reversed(alpha), strict=True):
            d = d + s * (al - (y @ d) / (s @ y))
        slope, t = g @ d, 1.0
        for _ in range(20):
            nf, ng = fun(x + t * d)
            if nf <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        if (t * d) @ (ng - g) > 1e-12:
            s_list, y_list = [*s_list, t * d][-memory:], [*y_list, ng - g][-memory:]
        done = f - nf < 1e-7
        x, f, g = x + t * d, nf, ng
        if done:
            break
    return x


def _joint(gram: np.ndarray, value: np.ndarray, off: np.ndarray, y: np.ndarray, size: int):
    """Loss and gradient of softmax(mean of embeddings) over bags [off[i], off[i + 1]) of n-grams.

    Parameters: DIM x size embeddings, DIM x 2 softmax weights, 2 biases, as one vector.
    """
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    bag = np.repeat(np.arange(len(y)), np.diff(off))
    value = value.astype(np.float32)

    def fun(theta: np.ndarray) -> tuple[float, np.ndarray]:
        emb, soft, bias = theta[: DIM * size].reshape(DIM, size), theta[DIM * size : -2].reshape(DIM, 2), theta[-2:]
        x = np.stack([np.bincount(bag, weights=e[gram] * value, minlength=len(y)) for e in emb], 1)
        z = x @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        loss = -(weight * np.log(p[np.arange(len(y)), y] + 1e-30)).sum() + DECAY / 2 * ((emb * emb).sum() + (soft * soft).sum())
        p[np.arange(len(y)), y] -= 1
        g = p * weight[:, None]
        gx = g @ soft.T
        ge = np.stack([np.bincount(gram, weights=gx[bag, d] * value, minlength=size) for d in range(DIM)]) + DECAY * emb
        return float(loss), np.concatenate([ge.ravel(), (x.T @ g + DECAY * soft).ravel(), g.sum(0)])

    return fun


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Model | None:
    """Fit on whole labelled texts; ``None`` if a class is missing."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, _ = raw(low)
    h, start, end, first = words(low)
    has = np.flatnonzero(np.diff(first))
    if not (toxic[has] == 1).any() or not (toxic[has] == 0).any():
        return None
    _, at, code = np.unique(h, return_index=True, return_inverse=True)
    code = code.ravel().astype(np.int32)
    gram, goff = _grams(data, start[at], end[at])
    gvalue = np.repeat((1 / np.diff(goff)).astype(np.float32), np.diff(goff))

    # n-grams of fewer than MIN_DOCS documents keep a zero vector: they could only memorise
    gword = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(goff))
    pair = np.unique(code.astype(np.int64) * len(first) + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    df = np.bincount(gram, weights=np.bincount(pair // len(first), minlength=len(at))[gword], minlength=BUCKETS)
    ok = df[gram] >= MIN_DOCS
    gram, gvalue, gword = gram[ok], gvalue[ok], gword[ok]
    goff = np.searchsorted(gword, np.arange(len(at) + 1))
    used, gram = np.unique(gram, return_inverse=True)
    gram = gram.ravel().astype(np.int32)
    del data, h, start, end

    def bags(a: np.ndarray, b: np.ndarray, y: np.ndarray):
        """The bags of n-grams of the word ranges [a, b)."""
        size = b - a
        off = np.concatenate([[0], np.cumsum(size)])
        cw = code[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
        n = np.diff(goff)[cw]
        goff2 = np.concatenate([[0], np.cumsum(n)])
        idx = np.repeat(goff[cw] - goff2[:-1], n) + np.arange(goff2[-1])
        scale = np.repeat(np.repeat(WINDOW / size, size), n)
        return gram[idx], gvalue[idx] * scale, goff2[off], y

    rng = np.random.default_rng(seed)
    turn = rng.permutation(has)
    held = np.zeros(len(first), bool)
    for t in (0, 1):  # a fifth of each class only sets the threshold, if there is enough of it
        part = turn[toxic[turn] == t]
        held[part[: len(part) // 5 if len(part) >= 10 else 0]] = True
    fitted = turn[~held[turn]]
    # start: one dimension holds each n-gram's log ratio of document frequency between the classes
    mine = np.zeros(len(first), bool)
    mine[fitted] = True
    share = []
    for t in (0, 1):
        here = pair[(mine & np.append(toxic == t, False))[pair % len(first)]] // len(first)
        n = (toxic[fitted] == t).sum()
        share.append((np.minimum(np.bincount(gram, weights=np.bincount(here, minlength=len(at))[gword], minlength=len(used)) / n, 1), n))
    (p0, n0), (p1, n1) = share
    signed = np.log((p1 + PRIOR / n1) / (p0 + PRIOR / n0))
    emb = (rng.random((DIM, len(used))) - 0.5) * 0.02
    emb[0] += signed / max(1, np.abs(signed).max())
    soft = np.zeros((DIM, 2))
    soft[0] = -1, 1
    theta = np.concatenate([emb.ravel(), soft.ravel(), np.zeros(2)])

    count = np.diff(first)[fitted]
    k = np.where(count <= WINDOW, 1, -(-(count - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(fitted)), k)
    wide = np.minimum(count, WINDOW)[doc]
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    a = first[fitted][doc] + np.minimum(nth * STRIDE, count[doc] - wide)
    b, y = a + wide, toxic[fitted][doc]
    judge = np.flatnonzero(held) if held.any() else has
    some, verdict = texts.take(pa.array(judge)), toxic[judge]

    def model_of(theta: np.ndarray) -> tuple[float, Model]:
        """Balanced accuracy on the judging documents at the best threshold, and the model with it."""
        emb, soft, bias = theta[: DIM * len(used)].reshape(DIM, -1), theta[DIM * len(used) : -2].reshape(DIM, 2), theta[-2:]
        table = np.zeros(BUCKETS, np.float32)
        table[used] = WINDOW * ((soft[:, 1] - soft[:, 0]) @ emb)
        m = Model(table, float(bias[1] - bias[0]), 0.5)
        good, m.threshold = _cut(score(some, Scorer(m)), verdict)
        return good, m

    best: tuple[float, Model] | None = None
    for _ in range(ROUNDS):
        emb, soft = theta[: DIM * len(used)].reshape(DIM, -1), theta[DIM * len(used) : -2].reshape(DIM, 2)
        v = np.bincount(gword, weights=((soft[:, 1] - soft[:, 0]) @ emb)[gram] * gvalue, minlength=len(at))
        c = np.concatenate([[0], np.cumsum(v[code])])
        z = (c[b] - c[a]) / wide
        order = np.lexsort((-z, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = nth
        high = np.quantile(z[(y == 0) & (rank == 0)], SURE)
        sure = (y == 1) & (z > high)  # a toxic document without such a window counts as wrongly labelled
        if not sure.any():
            sure = (y == 1) & (rank == 0)
        keep = np.flatnonzero(sure | ((y == 0) & ((rank < 3) | (nth == k[doc] // 2))))
        theta = _minimise(_joint(*bags(a[keep], b[keep], y[keep]), len(used)), theta, STEPS)
        new = model_of(theta)
        if best is None or new[0] >= best[0]:  # a later round that only memorises is not taken
            best = new
    return best[1]


def _cut(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(balanced accuracy, threshold) at the best threshold, in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    below_toxic = np.concatenate([[0], np.cumsum(t)])
    below_clean = np.concatenate([[0], np.cumsum(1 - t)])
    good = (below_toxic[-1] - below_toxic) / max(1, t.sum()) + below_clean / max(1, (1 - t).sum())
    good[1:-1][s[1:] == s[:-1]] = -1
    i = int(np.flatnonzero(good >= good.max() - 1e-12)[-1])
    lo, hi = (s[i - 1] if i else 0.0), (s[i] if i < len(s) else 1.0)
    return float(good[i] / 2), float(max(1e-9, (lo + hi) / 2))


class Scorer:
    """Logit contribution of words, remembered by their hash."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def __call__(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        i = np.searchsorted(self.known, u)
        i[i == len(self.known)] = 0
        hit = self.known[i] == u if len(self.known) else np.zeros(len(u), bool)
        v = np.empty(len(u), np.float32)
        v[hit] = self.value[i[hit]]
        if not hit.all():
            new = at[~hit]
            g, off = _grams(data, start[new], end[new])
            v[~hit] = _mean(self.model.grams[g], off)
            if len(self.known) > 500_000:  # a cache only: forgetting changes no result
                self.known, self.value = u, v
            else:
                k = np.concatenate([self.known, u[~hit]])
                order = np.argsort(k)
                self.known, self.value = k[order], np.concatenate([self.value, v[~hit]])[order]
        return v[inv.ravel()]


def score(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    """Probability of the most toxic window of each text; 0 without words."""
    out = np.zeros(len(texts))
    for i, part in pieces(texts, 2 << 20):
        low = pc.utf8_lower(pc.fill_null(part, ""))
        data, _ = raw(low)
        h, start, end, first = words(low)
        if len(h) == 0:
            continue
        c = np.concatenate([[0], np.cumsum(scorer(data, h, start, end).astype(np.float64))])
        count = np.diff(first)
        some = np.flatnonzero(count)
        n = count[some]
        k = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
        off = np.concatenate([[0], np.cumsum(k)])
        at = (np.arange(off[-1]) - np.repeat(off[:-1], k)) * STRIDE
        wide = np.repeat(np.minimum(n, WINDOW), k)
        a = np.repeat(first[some], k) + np.minimum(at, np.repeat(n, k) - wide)
        z = (c[a + wide] - c[a]) / wide + scorer.model.bias
        out[i + some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, off[:-1]), -500, 500)))
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model | None:
    """Train on at most ``per_class`` labelled documents of each class, chosen by a hash of doc_id."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    picked = None
    for t in (0, 1):
        part = one.where(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").toArrow()
    if rows.num_rows == 0:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows["text"].combine_chunks(), rows["toxic"].to_numpy().astype(np.int64))


def score_column(model: Model | None, column: str = "text"):
    """Column of the score of each text."""
    if model is None:
        return F.lit(0.0)
    held: list[Scorer] = []

    @F.arrow_udf("double")
    def toxic_score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(model))
        out = pa.array(score(texts, held[0]))
        relax()
        return out

    return toxic_score(F.col(column))


def toxic_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, toxic_score) of the documents at or over the model's threshold."""
    scored = docs.select("doc_id", score_column(model).alias("toxic_score"))
    return scored.where(F.col("toxic_score") >= F.lit(model.threshold if model else 2.0))


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without its toxic rows; columns as they are."""
    if model is None:
        return docs
    s = fresh("toxic")
    return docs.withColumn(s, score_column(model)).where(F.col(s) < model.threshold).drop(s)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic_documents(docs, fit(spark, docs, documents(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
