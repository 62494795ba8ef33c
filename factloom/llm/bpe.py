"""BPE encoding and decoding with forced-boundary splitting (operator 1).

A pair of adjacent bytes that no vocabulary token contains can never end up in
one token, so between the two bytes is a certain cut: the fragments between
certain cuts are encoded independently and their ids concatenated.  The 256 x
256 table of pairs comes from the vocabulary once; the cuts of a batch are one
vectorised lookup over its bytes, and every one of them is taken.

A tokenizer with a pre-tokenising pattern additionally never merges across the
bounds of the pattern's matches.  Those of the byte-level 50k pattern are found by
vectorised comparisons of neighbouring characters' classes, those of another pattern by
running it; fragments end at the union of both kinds.  Distinct fragments are
merged side by side in numpy: those with the same number of parts are one matrix,
and each step joins in every row its leftmost pair of least rank.

The ids equal those of the plain algorithm on the whole text.  Defined results: a null text
gives null ids, an empty one an empty list; a text is encoded whole, however long, and as it is
(strings of special tokens are ordinary text); decoding returns exactly its bytes.  Repeated rows
each give their ids; pairs of equal rank are joined from the left.  An empty table gives no rows.
Columns of other names than ``doc_id`` and ``text`` are ignored unless kept by name.  Of a text that
another pattern matches in part only the matches are encoded.  The vocabulary is
a tiktoken-style file (base64 token, space, rank), read on the driver from a path
that is a parameter; a token that merges can't produce never appears.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces, raw, relax
from ._util import documents

VOCABULARY = os.environ.get("FACTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokenising pattern of the byte-level 50k vocabulary; None is plain BPE over the whole text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments remembered at most; a cache only, results don't depend on it.
REMEMBERED = 1 << 18
#: Fragments of more bytes are merged one by one with a heap instead of in matrices; the ids are the same.
WIDE = 64
_NONE = np.int32((1 << 31) - 1)


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 the space, 2 letters, 3 numbers, 4 others (invalid bytes too)."""
    out = np.full(0x110000, 4, np.uint8)
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = every.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pat in ((0, r"\s+"), (2, r"\p{L}+"), (3, r"\p{N}+")):
        for m in regex.finditer(pat, text):
            out[every[m.start() : m.end()]] = kind
    out[32] = 1
    return out


class Vocabulary:
    """Ranks, the table of byte pairs inside tokens, and the flat bytes of all tokens."""

    def __init__(self, content: bytes):
        pairs = [line.split() for line in content.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.size = max(self.ranks.values()) + 1
        self.inside = np.zeros((256, 256), bool)
        lens = np.zeros(self.size, np.int64)
        parts = [b""] * self.size
        for t, r in self.ranks.items():
            parts[r], lens[r] = t, len(t)
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                self.inside[a[:-1], a[1:]] = True
        self.lens, self.flat = lens, np.frombuffer(b"".join(parts), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(lens)])[:-1]

    @functools.cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of tokens that forms a token, as sorted keys, and that token."""
        get, keys, made = self.ranks.get, [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        return np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    @functools.cached_property
    def bytes_ids(self) -> np.ndarray:
        """Token of each single byte."""
        return np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens forms, _NONE where it forms none."""
        keys, made = self.joins
        if len(keys) == 0:
            return np.full(len(a), _NONE)
        k = a.astype(np.int64) << 32 | b
        at = np.searchsorted(keys, k)
        at[at == len(keys)] = 0
        return np.where(keys[at] == k, made[at], _NONE)

    @functools.cached_property
    def byte_joins(self) -> np.ndarray:
        """:meth:`joined` of all pairs of single bytes."""
        ids = self.bytes_ids
        return self.joined(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)

    @property
    def bits(self) -> int:
        """Bits that hold any id."""
        return max(1, (self.size - 1).bit_length())


_loaded: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    name = hashlib.sha256(content).hexdigest()
    if name not in _loaded:
        _loaded[name] = Vocabulary(content)
    return _loaded[name]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: again and again the leftmost pair of least rank becomes one token."""
    n = len(piece)
    if n <= 64:
        parts = [piece[i : i + 1] for i in range(n)]
        rank = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(n - 1)]
        while rank:
            low = min(rank)
            if low == 1 << 60:
                break
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))  # end of the part that starts here, 0 if none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        m = end[i]
        if not m or m >= j or end[m] != j:
            continue
        end[i], end[m] = j, 0
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if i and (r := ranks.get(piece[before[i] : j])) is not None:
            heapq.heappush(heap, (r, before[i], j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def merge_many(frags: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all fragments, number of each one's ids), as :func:`merge` gives them.

    A pool holds all fragments that have ``w`` parts left, as a matrix of parts and one of the tokens that neighbours
    form.  A step joins one pair in each row, so all rows get to ``w - 1`` parts, where the next shorter fragments join them.
    """
    size = np.array([len(f) for f in frags], np.int64)
    count = np.zeros(len(frags), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(size > WIDE).tolist():
        done.append((np.array([i]), np.array([merge(frags[i], vocab.ranks)], np.int32)))
    short = np.flatnonzero((size <= WIDE) & (size > 0))
    by = [short[size[short] == w] for w in range(WIDE + 1)]
    most = int(size[short].max()) if len(short) else 0
    who, part, pair = np.zeros(0, np.int64), np.zeros((0, most), np.int32), np.zeros((0, max(0, most - 1)), np.int32)
    for w in range(most, 0, -1):
        if len(new := by[w]):
            raw_ = np.frombuffer(b"".join([frags[i] for i in new.tolist()]), np.uint8).reshape(len(new), w)
            who = np.concatenate([who, new])
            part = np.concatenate([part, vocab.bytes_ids[raw_]])
            pair = np.concatenate([pair, vocab.byte_joins[raw_[:, :-1], raw_[:, 1:]]])
        if w == 1 or len(who) == 0:
            if len(who):
                done.append((who, part))
            who, part, pair = who[:0], part[:0, : w - 1], pair[:0, : max(0, w - 2)]
            continue
        low = pair.min(1)
        if (low == _NONE).any():
            end = low == _NONE
            done.append((who[end], part[end]))
            who, part, pair, low = who[~end], part[~end], pair[~end], low[~end]
        n = len(who)
        rows, at = np.arange(n), pair.argmin(1)
        part[rows, at] = low
        stay = np.ones((n, w), bool)
        stay[rows, at + 1] = False
        part = part[stay].reshape(n, w - 1)
        stay = np.ones((n, w - 1), bool)
        stay[rows, at] = False
        pair = pair[stay].reshape(n, w - 2)
        r = np.flatnonzero(at > 0)
        pair[r, at[r] - 1] = vocab.joined(part[r, at[r] - 1], part[r, at[r]])
        r = np.flatnonzero(at < w - 2)
        pair[r, at[r]] = vocab.joined(part[r, at[r]], part[r, at[r] + 1])
    for i, m in done:
        count[i] = m.shape[1]
    first = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(first[-1], np.int32)
    for i, m in done:
        ids[first[i][:, None] + np.arange(m.shape[1])] = m
    return ids, count


def bounds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a match of PATTERN begins at each byte of the texts that begin at ``off``.

    Runs of letters, of numbers and of other characters are matches, with one space before them if there is one; white space
    before them is one match up to its last character, which is one of its own if it isn't a space; an apostrophe that
    begins a match takes s, t, m, d, re, ve or ll with it.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if n == 0:
        return start
    if (data < 128).all():
        point, at = data, None
    else:
        text = data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass")
        point = np.frombuffer(text, "<u4")
        wide = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        wide[(point >= 0xDC80) & (point <= 0xDCFF)] = 1  # a byte that isn't UTF-8
        at = np.cumsum(wide) - wide
    kind = classes()[point]
    group = np.maximum(kind, 1)
    m = len(kind)
    head = np.zeros(m + 3, bool)
    begin = off[:-1][off[:-1] < n]
    head[begin if at is None else np.searchsorted(at, begin)] = True
    head[m:] = True
    b = np.ones(m, bool)
    np.not_equal(group[1:], group[:-1], out=b[1:])
    b |= head[:m]
    i = np.flatnonzero(b & ~head[:m] & (group > 1))
    i = i[group[i - 1] == 1]  # white space goes before them
    b[i[kind[i - 1] == 1]] = False
    b[i - 1] = True
    q = np.flatnonzero((point == 39) & b)
    q = q[~head[q + 1]]
    if len(q):
        far = np.concatenate([point, np.zeros(2, point.dtype)])
        x, y = far[q + 1], np.where(head[q + 2], 0, far[q + 2])
        one = (x == 115) | (x == 116) | (x == 109) | (x == 100)
        two = ~one & ((((x == 114) | (x == 118)) & (y == 101)) | ((x == 108) & (y == 108)))
        b[q[one | two] + 1] = False
        end = np.concatenate([q[one] + 2, q[two] + 3])
        b[end[end < m]] = True
    start[b if at is None else at[b]] = True
    return start


class Encoder:
    """Encodes and decodes batches; remembers fragments."""

    def __init__(self, vocab: Vocabulary, pattern: str | None = PATTERN):
        self.vocab, self.pattern = vocab, regex.compile(pattern) if pattern and pattern != PATTERN else None
        self.plain = not pattern
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes | int, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.count, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def cuts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(starts of fragments, whether each belongs to a match; None if all do): all certain cuts, the pattern's bounds, the texts' starts."""
        inside = None
        if self.plain:
            start = np.zeros(len(data), bool)
        elif self.pattern is None:
            start = bounds(data, off)
        else:
            start, inside = np.zeros(len(data) + 1, bool), np.zeros(len(data), bool)
            for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = data[a:z].tobytes().decode("utf-8", "surrogateescape")
                back = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogateescape")) for c in text])]) if len(text) != z - a else None
                for x in self.pattern.finditer(text):
                    lo, hi = x.span() if back is None else back[list(x.span())]
                    start[[a + lo, a + hi]] = True
                    inside[a + lo : a + hi] = True
            start = start[:-1]
        start[1:] |= ~self.vocab.inside[data[:-1], data[1:]]
        start[off[:-1][off[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        return at, None if inside is None else inside[at]

    def _learn(self, keys: list, frags: list[bytes]) -> None:
        """Remember the ids of new fragments under their keys."""
        ids, count = merge_many(frags, self.vocab)
        while self.n + len(frags) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.n : self.n + len(frags)] = self.used + np.cumsum(count) - count
        self.count[self.n : self.n + len(frags)] = count
        self.codes.update(zip(keys, range(self.n, self.n + len(frags)), strict=True))
        self.used += len(ids)
        self.n += len(frags)

    def _codes(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Number of each fragment; one of up to 7 bytes is known by a 64-bit word of its bytes and length, another by its bytes."""
        size = np.diff(start, append=len(data))
        text = data.tobytes()
        code = np.empty(len(start), np.int64)
        short = np.flatnonzero(size < 8)
        word = np.ndarray(len(data), "<u8", text + bytes(8), 0, (1,))
        n = size[short].astype(np.uint64)
        key = word[start[short]] & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1)) | n << np.uint64(56)
        u, inverse = np.unique(key, return_inverse=True)
        keys, get = u.tolist(), self.codes.get
        got = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(got < 0).tolist()
        if new:
            mine = [keys[i] for i in new]
            got[new] = np.arange(self.n, self.n + len(new))
            self._learn(mine, [k.to_bytes(8, "little")[: k >> 56] for k in mine])
        code[short] = got[inverse.ravel()]
        wide = np.flatnonzero(size > 7)
        lo = start[wide]
        frags = [text[i:j] for i, j in zip(lo.tolist(), (lo + size[wide]).tolist(), strict=True)]
        got = np.array([get(f, -1) for f in frags], np.int64)
        new = np.flatnonzero(got < 0).tolist()
        if new:
            mine = list({frags[i]: None for i in new})
            self._learn(mine, mine)
            got[new] = [self.codes[frags[i]] for i in new]
        code[wide] = got
        return code

    def encode_flat(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if len(self.codes) > REMEMBERED:
            self._forget()
        start, kept = self.cuts(data, off)
        code = self._codes(data, start)
        n = self.count[code]
        if kept is not None:
            n = n * kept
        cum = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[code] - cum[:-1], n) + np.arange(cum[-1])]
        return ids, cum[np.searchsorted(start, off)]

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        n = self.vocab.lens[ids]
        cum = np.concatenate([[0], np.cumsum(n)])
        return self.vocab.flat[np.repeat(self.vocab.first[ids] - cum[:-1], n) + np.arange(cum[-1])]

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of ids of each text."""
        ids, off, base = [], [np.zeros(1, np.int64)], 0
        for _, part in pieces(texts):
            x, o = self.encode_flat(*raw(part))
            ids.append(x)
            off.append(o[1:] + base)
            base += len(x)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        valid = texts.is_valid() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.concatenate(off), pa.int32()), pa.array(flat, pa.int32()), mask=None if valid is None else pa.compute.invert(valid))

    def decode(self, lists: pa.Array) -> pa.Array:
        """Text of each list of ids; bytes that aren't UTF-8 become U+FFFD."""
        return pa.array([None if x is None else self.decode_flat(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(content: bytes, pattern: str | None = PATTERN) -> Encoder:
    name = (hashlib.sha256(content).hexdigest(), pattern)
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary(content), pattern)
    return _encoders[name]


def _holder(content: bytes, pattern: str | None):
    """Encoder of a worker, made at its first batch; the content is hashed once a task."""
    held: list[Encoder] = []

    def get() -> Encoder:
        if not held:
            held.append(encoder(content, pattern))
        return held[0]

    return get


def encode_column(column: Column, path: str = VOCABULARY, pattern: str | None = PATTERN) -> Column:
    get = _holder(read_vocabulary(path), pattern)

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return get().encode(texts)

    return bpe_encode(column)


def decode_column(column: Column, path: str = VOCABULARY) -> Column:
    get = _holder(read_vocabulary(path), None)

    @F.arrow_udf("string")
    def bpe_decode(lists: pa.Array) -> pa.Array:
        return get().decode(lists)

    return bpe_decode(column)


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str | None = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``..., n_tokens, token_ids, decodes): ids of each text, and whether decoding them gives the text's bytes."""
    keep = ("doc_id", *keep)
    get = _holder(read_vocabulary(path), pattern)

    def run(batches):
        for b in batches:
            for i, part in pieces(b["text"], 4 << 20):
                enc, ids, off, ok = get(), [], [np.zeros(1, np.int64)], []
                base = 0
                for _, small in pieces(part):
                    data, o = raw(small)
                    x, t = enc.encode_flat(data, o)
                    back = enc.decode_flat(x)
                    if len(back) == len(data) and np.array_equal(back, data):
                        ok.append(np.ones(len(small), bool))
                    else:
                        ok.append(np.array([np.array_equal(enc.decode_flat(x[t[k] : t[k + 1]]), data[o[k] : o[k + 1]]) for k in range(len(small))]))
                    ids.append(x)
                    off.append(t[1:] + base)
                    base += len(x)
                o = np.concatenate(off)
                null = np.asarray(part.is_null())
                lists = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*(b[c].slice(i, len(part)) for c in keep), pa.array(np.diff(o).astype(np.int32), mask=null), lists, pa.array(np.concatenate(ok), mask=null)], [*keep, "n_tokens", "token_ids", "decodes"])
            relax()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}n_tokens int, token_ids array<int>, decodes boolean")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe}
