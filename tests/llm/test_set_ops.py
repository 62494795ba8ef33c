"""Mixing, search, neighbours, near duplicates, toxicity, pipeline: against brute force and on edge cases."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import ann, mixing, neardup, pii, topk, toxicity
from factloom.llm._text import mix, words

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, KINDS + extra)


def sourced(spark, **n):
    rows = [(f"{s}{i}", s, i) for s, k in n.items() for i in range(k)]
    return docs(spark, [(j, t, "en" if i % 2 else "xx", s, len(t)) for j, (t, s, i) in enumerate(rows)])


def test_mixing_hits_shares(spark):
    df = sourced(spark, a=300, b=40, c=7)
    out = mixing.mixed(df, 200, {"a": 0.25, "b": 0.5, "c": 0.25, "absent": 1.0})
    assert Counter(r.source for r in out.collect()) == {"a": 50, "b": 100, "c": 50}
    # every document of an over-asked source has its whole copies, none more than one beyond
    per = Counter(r.doc_id for r in out.where("source = 'b'").collect())
    assert len(per) == 40
    en = [per[r.doc_id] for r in df.where("source = 'b' AND lang = 'en'").collect()]
    assert set(en) == {4} and sum(en) == 80
    assert out.columns == df.columns


def test_mixing_inclusion_follows_odds(spark):
    df = sourced(spark, a=4000)
    got = Counter(r.lang for r in mixing.mixed(df, 1000, {"a": 1}).collect())
    assert got["en"] + got["xx"] == 1000 and abs(got["en"] - 800) < 60  # four times as likely


def test_mixing_edges(spark):
    rows = [(None, None, None, None, None), (1, "a", None, "s", 1), (1, "a", None, "s", 1), (1, "b", None, "s", 1), (2, "", "en", None, 0)]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], KINDS + ", copies int, s string")
    out = mixing.mixed(df, 50)
    assert out.columns == df.columns and out.count() == 50
    assert {r.source for r in out.collect()} == {None, "s"}
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(df, 10, {"s": 1}).where("source IS NULL").count() == 0
    assert mixing.mixed(df, 0).count() == 0


def brute_topk(rows, queries, k):
    ws = lambda t: words(pa.array([t or ""]))[0].tolist()
    tf = [(d, Counter(w), len(w)) for d, t in rows for w in [ws(t)]]
    n, mean = len(rows), max(1.0, sum(x[2] for x in tf) / max(1, len(rows)))
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, q in queries:
        got = []
        for d, c, size in tf:
            s = 0
            for w in set(ws(q)):
                if c[w]:
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    s += math.floor(idf * (c[w] * (topk.K1 + 1) / (c[w] + topk.K1 * (1 - topk.B + topk.B * size / mean))) * topk.SCALE + 0.5)
            if s:
                got.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(got)[:k])]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, "w59 " * 3000)]
    queries = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(20)] + [(50, None), (51, ""), (52, "unknown"), (53, "w0")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, score int")
    q = spark.createDataFrame(queries, "item_id long, text string")
    want = brute_topk(rows, queries, 5)
    assert sorted(map(tuple, topk.search(d, q, k=5).collect())) == want
    monkeypatch.setattr(topk, "SENT_WORDS", 8)
    monkeypatch.setattr(topk, "STEP", 16)
    assert sorted(map(tuple, topk.search(d, q, k=5).collect())) == want
    assert topk.search(d.limit(0), q).count() == 0 and topk.search(d, q.limit(0)).count() == 0


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)) + 3 * rng.standard_normal((8, 16))[rng.integers(0, 8, 700)]
    x[5] = x[6] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)], "vec_id long, embedding array<float>, cell string")
    got = defaultdict(list)
    for r in ann.neighbours(df, k=5, cell=64).collect():
        got[r.vec_id].append((r.rank, r.neighbour, r.distance))
    y = x.astype(np.float32).astype(np.float64)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    hit = 0
    for i in range(700):
        want = set(np.argsort(d[i], kind="stable")[:5].tolist())
        assert [r[0] for r in sorted(got[i])] == [1, 2, 3, 4, 5]
        assert all(abs(d[i, j] - z) < 1e-4 for _, j, z in got[i])
        hit += len(want & {j for _, j, _ in got[i]})
    assert hit / 3500 >= 0.9
    assert {j for _, j, _ in sorted(got[5])[:2]} == {6, 7}


def test_ann_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df).collect()
    assert len(got) == 12 and {r.vec_id for r in got} == {1, 2, None}
    assert ann.neighbours(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(300)], "vec_id long, embedding array<float>")
    same = ann.neighbours(many, k=3, cell=50).where("vec_id = 9").orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in same] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_ann_asked_rows_blocks_and_names(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((300, 6)), 1)
    x[100:200] = x[0]  # a third of all rows are equal
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, rid int, x int")
    visits = []
    got = ann.neighbours(df, k=4, cell=16, asked=F.col("vec_id") % 50 == 0, confidence=1 - 1e-12, visits=visits).collect()
    y = x.astype(np.float32).astype(np.float64)
    want = []
    for i in range(0, 300, 50):
        d = ((y - y[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(300), d)) if j != i][:4]
        want += [(i, n + 1, j, round(float(np.sqrt(d[j])), 9)) for n, j in enumerate(order)]
    assert sorted((r.vec_id, r.rank, r.neighbour, round(r.distance, 9)) for r in got) == sorted(want)
    assert len(visits) > 1 and visits[0][1] >= 6


def test_ann_stops_before_the_end(spark):
    """Where vectors lie in groups, queries visit a part of the cells and still find their neighbours."""
    rng = np.random.default_rng(2)
    x = (4 * rng.standard_normal((30, 12)))[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    visits = []
    got = defaultdict(set)
    for r in ann.neighbours(df, k=5, cell=32, asked=F.col("vec_id") % 50 == 0, visits=visits).collect():
        got[r.vec_id].add(r.neighbour)
    y, hit = x.astype(np.float32).astype(np.float64), 0
    for i in range(0, 3000, 50):
        d = ((y - y[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(got[i] & set(np.argsort(d)[:5].tolist()))
    assert hit / 300 >= 0.9
    assert sum(n for _, n in visits) < 60 * 128 / 2


def test_chi_square():
    assert ann.chi2_cdf(ann.stop_ratio(0.9)) == pytest.approx(0.9)
    z = np.random.default_rng(0).standard_normal((100000, ann.DIM))
    assert ((z * z).sum(1) < ann.stop_ratio(0.9)).mean() == pytest.approx(0.9, abs=0.01)


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def signature_rows(texts):
    return np.frombuffer(b"".join(neardup.signatures(pa.array(texts)).to_pylist()), np.uint16).reshape(len(texts), -1)


def corpus(rng):
    fresh = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(fresh(120)) for _ in range(40)]
    for size, changes in ((2, 2), (5, 4), (30, 3)):
        texts += family(rng, fresh(150), size, changes)
    return texts + [texts[0], texts[0], "one", "one", "", "", "!!", "..."]


def test_neardup_pairs_against_brute_force(spark):
    texts = corpus(random.Random(2))
    sig = signature_rows(texts)
    sigs = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sig)], "rid long, sig binary")
    d = (sig[:, None] != sig[None]).sum(-1)
    want = {(i, j, int(d[i, j])) for i in range(len(sig)) for j in range(i + 1, len(sig)) if d[i, j] <= neardup.RADIUS}
    assert {tuple(r) for r in neardup.pairs(sigs).collect()} == want
    # pigeonhole: signatures exactly at the radius, spread as badly as can be, are found
    a = sig[0].copy()
    b = a.copy()
    for k in range(neardup.RADIUS):
        b[(k % neardup.CHUNKS) * neardup.PER_CHUNK + k // neardup.CHUNKS] ^= 1
    two = spark.createDataFrame([(0, a.tobytes()), (1, b.tobytes())], "rid long, sig binary")
    assert [tuple(r) for r in neardup.pairs(two).collect()] == [(0, 1, neardup.RADIUS)]


def test_dedup_against_brute_force(spark):
    texts = corpus(random.Random(7))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sig = signature_rows(texts)
    near = (sig[:, None] != sig[None]).sum(-1) <= neardup.RADIUS
    root = list(range(len(texts)))
    for i in range(len(texts)):  # components
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    got = {r.doc_id for r in neardup.dedup(docs(spark, rows)).collect()}
    assert got == {i for i in range(len(texts)) if root[i] == i}
    pairs = {(r.doc_id, r.keep_doc_id) for r in neardup.duplicates(docs(spark, rows)).collect()}
    assert pairs == {(i, r) for i, r in enumerate(root) if i != r}


def test_dedup_edges(spark):
    rows = [(None, "a b c d", None, None, None), (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, "s", 0), (3, None, None, "s", 0), (4, "", None, "s", 0), (5, "", None, "s", 0), (6, "long " * 30000, None, "s", 0), (2, None, None, "s", 0)]
    df = docs(spark, [(*r, 1, 2) for r in rows], ", rid int, sig int")
    out = neardup.dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3, 4, 6]
    assert neardup.dedup(df.limit(0)).count() == 0


TOXIC = ["idiot", "moron", "worthless", "scum", "loser"]


def labelled(rng, n, toxic_share=0.3):
    vocab = ["".join(rng.choices("abcdehinorst", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        w = rng.choices(vocab, k=rng.randint(20, 120))
        t = int(rng.random() < toxic_share)
        for _ in range(rng.randint(2, 5) if t else 0):
            w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        out.append((" ".join(w), t))
    return out


def test_toxicity_held_out_and_misspellings():
    rng = random.Random(11)
    rows = labelled(rng, 900)
    train, test = rows[:600], rows[600:]
    model = toxicity.train(pa.array([t for t, _ in train]), np.array([y for _, y in train]))
    score = toxicity.score(pa.array([t for t, _ in test]), toxicity.Scorer(model))
    y = np.array([y for _, y in test])
    flag = score >= model.threshold
    assert flag[y == 1].mean() >= 0.95 and flag[y == 0].mean() <= 0.03
    clean = next(t for t, v in test if v == 0)
    spelt = [clean + " " + w for w in ("idiots worthlesss morons", "idiott worthles moronn")]
    assert (toxicity.score(pa.array(spelt), toxicity.Scorer(model)) > toxicity.score(pa.array([clean]), toxicity.Scorer(model))).all()
    # the worst window counts, wherever it is
    deep = " ".join([clean] * 200) + " idiot moron scum " + " ".join([clean] * 200)
    assert toxicity.score(pa.array([deep]), toxicity.Scorer(model))[0] >= model.threshold


def test_toxicity_edges(spark):
    rng = random.Random(5)
    r = labelled(rng, 300)
    rows = [(i, t, "en", "s", 0) for i, (t, _) in enumerate(r)]
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(r)] + [(0, 1, None), (None, 1, 1), (5, 1, r[5][1])], "doc_id long, quality int, toxic int")
    df = docs(spark, [(*x, 0.5) for x in [*rows, (900, None, None, None, None), (901, "", None, None, 0), (902, "!!!", None, None, 3), (903, "word " * 30000, None, None, 0), rows[0]]], ", toxic_score double")
    model = toxicity.fit(spark, df, labels)
    out = toxicity.drop_toxic(df, model)
    assert out.columns == df.columns
    kept = {x.doc_id for x in out.collect()}
    assert {900, 901, 902} <= kept
    gone = {x.doc_id for x in toxicity.toxic_documents(df, model).collect()}
    assert gone | kept == {x[0] for x in rows} | {900, 901, 902, 903} and not gone & kept
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0
    assert toxicity.fit(spark, df, labels.limit(0)) is None and toxicity.fit(spark, df.limit(0), labels) is None
    assert toxicity.drop_toxic(df, None).count() == df.count()
    assert toxicity.fit(spark, df, labels.where("toxic = 0")) is None


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as C
    from factloom.llm import bpe

    rng = random.Random(9)
    r = labelled(rng, 240)
    rows = [(i, t, "en", f"s{i % 3}" if i % 2 else "s0", len(t)) for i, (t, _) in enumerate(r)]
    rows += [(1000 + i, rows[i][1] + " end", "en", "s1", len(rows[i][1]) + 4) for i in range(0, 60, 3)]
    rows += [(2000, "write to ann@mail.example.com " + " ".join(f"q{i}" for i in range(30)), "en", "s2", 100), (2001, None, None, None, None)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(r)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = C.run(spark, str(tmp_path)).collect()

    model = toxicity.fit(spark, spark.createDataFrame(rows, KINDS), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = toxicity.score(pa.array([x[1] for x in rows]), toxicity.Scorer(model))
    left = [x for x, s in zip(rows, score) if s < model.threshold]
    text = [x for x in left if x[1] is not None]
    sig = signature_rows([x[1] for x in text])
    near = (sig[:, None] != sig[None]).sum(-1) <= neardup.RADIUS
    order = sorted(range(len(text)), key=lambda i: text[i][0])
    kept, seen = [x for x in left if x[1] is None], set()
    for i in order:
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        kept.append(text[i])
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
    masked = [(d, pii.redacted(t), *rest) for d, t, *rest in kept]
    n = Counter(x[3] for x in masked)
    out = Counter(x.source for x in got)
    w = {s: math.floor(math.sqrt(c) * 1e6) for s, c in n.items()}
    assert sum(out.values()) == len(masked)
    assert all(abs(out[s] - len(masked) * w[s] / sum(w.values())) < 1 for s in n)
    plain = tiktoken.Encoding("p", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.read_vocabulary()).ranks, special_tokens={})
    ids = {d: None if t is None else plain.encode_ordinary(t) for d, t, *_ in masked}
    assert {x.doc_id for x in got} <= set(ids) and all(x.token_ids == ids[x.doc_id] for x in got)
    assert C.STAGES[1][0] == "near_dedup" and [s[0] for s in C.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
    docs_ = spark.createDataFrame(rows, KINDS)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs_, str(tmp_path)).columns == docs_.columns


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    import corpus_pipeline as C

    long = " ".join(f"w{i % 977}x{i}" for i in range(150_000))
    rows = [(1, "some words of a text", "en", "s", 4, 1, 2), (1, "some words of a text", "en", "s", 4, 1, 2), (2, None, "en", "s", None, 1, 2), (None, "another text without an id", None, None, None, None, None), (3, "", "en", "s", 0, 1, 2), (4, "", "de", "s", 0, 1, 2), (5, long, "en", "t", len(long), 1, 2), (6, None, None, None, None, None, None)]
    kinds = KINDS + ", sig int, rid int"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs_, str(tmp_path))
        assert out.columns == docs_.columns
        if name != "mixing":
            assert out.count() == (6 if name == "near_dedup" else 8), name
    got = C.run(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r.doc_id for r in got} <= {1, 2, 3, 5, 6, None}
    assert all(r.token_ids is None for r in got if r.doc_id in (2, 6)) and all(r.n_tokens == 0 for r in got if r.doc_id == 3)
    assert all(r.n_tokens > 150_000 for r in got if r.doc_id == 5)


def test_empty_corpus(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_entry_has_all(spark):
    import __spark_entry__ as E

    names = set(E.queries())
    assert {"pipeline"} | {f"op{i}_" for i in range(1, 11)} <= {"pipeline"} | {n.split("_")[0] + "_" for n in names if n.startswith("op")}
    assert set(E.oracle_sql()) <= names
    assert F is not None


def _joined(ids, a, b):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        up[max(root(x), root(y))] = min(root(x), root(y))
    return {i: root(i) for i in ids}


def bucket_of(rng, n):
    """Members that share four slots: far ones, near groups, chains."""
    s = rng.integers(0, 1 << 16, (n, neardup.SLOTS)).astype(np.uint16)
    for i in range(1, n):
        if rng.random() < 0.6:
            s[i] = s[rng.integers(0, i)]
            k = rng.integers(0, 40)
            s[i, rng.integers(0, neardup.SLOTS, k)] = rng.integers(0, 1 << 16, k)
    s[:, [0, 2, 3, 5]] = 7
    return s


def test_connect_by_second_keys_joins_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (60, 200, 200):
        s, ids = bucket_of(rng, n), np.sort(rng.choice(10_000, n, replace=False))
        i, j = np.nonzero(np.triu((s[:, None] != s[None]).sum(2) <= neardup.RADIUS, 1))
        want = _joined(ids, ids[i], ids[j])
        monkeypatch.setattr(neardup, "SPLIT_FROM", 1 << 30)
        assert _joined(ids, *neardup.connect(ids, s)) == want
        monkeypatch.setattr(neardup, "SPLIT_FROM", 4)
        for scans in (0, 1, 5):
            monkeypatch.setattr(neardup, "SCANS", scans)
            assert _joined(ids, *neardup.connect(ids, s)) == want


def test_connect_of_many_far_members_is_fast():
    s = np.random.default_rng(1).integers(0, 1 << 16, (100_000, neardup.SLOTS)).astype(np.uint16)
    s[:, :4] = 7
    began = time.perf_counter()
    assert len(neardup.connect(np.arange(len(s)), s)[0]) == 0
    assert time.perf_counter() - began < 60


def test_hot_buckets_are_split_over_the_cluster(spark, monkeypatch):
    s = bucket_of(np.random.default_rng(8), 300)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(s)], "rid long, sig binary")
    want = _joined(range(300), *np.nonzero(np.triu((s[:, None] != s[None]).sum(2) <= neardup.RADIUS, 1)))
    for hot in (1 << 17, 20):
        monkeypatch.setattr(neardup, "HOT", hot)
        e = neardup.edges(df).collect()
        assert _joined(range(300), [r.a for r in e], [r.b for r in e]) == want


def test_dedup_of_one_doc_id_with_different_texts(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5), (1, "another text altogether with words of its own", 5), (1, text, 5), (2, text + " more", 5)], "doc_id long, text string, sig int")
    got = sorted((r.doc_id, r.text) for r in neardup.dedup(df).collect())
    assert got == sorted([(1, text), (1, "another text altogether with words of its own")])


def test_toxicity_against_a_naive_scorer():
    """Every window of a text by loops over its words and their n-grams."""
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.standard_normal(toxicity.BUCKETS).astype(np.float32), -0.3, 0.5)

    def naive(text):
        ws = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        value = []
        for w in ws:
            c = [1, *(b + 2 for b in w.encode()), 1]
            grams = []
            for n in toxicity.NGRAMS:
                for i in range(len(c) - n + 1):
                    h = 0
                    for k, x in enumerate(c[i : i + n]):
                        h = x if k == 0 else (h * 1_000_003 + x) % (1 << 64)
                    grams.append(int(mix(np.array([(h + n) % (1 << 64)], np.uint64))[0]) % toxicity.BUCKETS)
            value.append(float(np.mean([model.grams[g] for g in grams])))
        if not ws:
            return 0.0
        size = toxicity.WINDOW
        starts = sorted({min(i, max(0, len(ws) - size)) for i in range(0, max(1, len(ws) - size + toxicity.STRIDE), toxicity.STRIDE)})
        z = max(float(np.mean(value[i : i + size])) for i in starts) + model.bias
        return 1 / (1 + math.exp(-z))

    words_ = ["a", "übel", "idiot", "1d10t", "世界", "the", "x" * 30, "don't"]
    r = random.Random(4)
    texts = [None, "", "...", "one", *[" ".join(r.choices(words_, k=r.randrange(1, 60))) for _ in range(60)]]
    got = toxicity.score(pa.array(texts), toxicity.Scorer(model))
    assert np.allclose(got, [naive(t) for t in texts], atol=1e-5)
