"""HTML extraction with site style trees (operator 2).

The DOMs of a host's pages are merged into one style tree.  An element node is
known by its place: the style (sequence of children's tags and classes) of its
parent, and its position therein.  Importance is an entropy:

* of a leaf, one minus the mean entropy of its features (sentences, link
  targets) over the pages, with logarithms to the base of the number of the host's
  pages: what is the same everywhere is worth nothing, what a few copies of an
  article share is worth much, also where no other page has their layout;
* of an inner node with l styles, ``(1 - G**l)`` times the entropy of its styles
  (logarithms to the base of the number of pages that have the node) plus ``G**l`` times the styles' importances weighted by frequency, a style's being the
  mean of its children's.

A node that only one page has is worth 1, a leaf without features (a line break)
nothing, but it isn't removed alone.  A branch of which no node reaches
``THRESHOLD`` is removed from each page; the rest gives the page's text.

Pages are read three times and never shuffled: what is shuffled are counts of
styles, the features of leaves that two pages share, and one group of
shared nodes for each host.  A hot host is counted by many tasks; only its merged tree is one group.

Defined results: a null html gives null text, an empty one an empty text; script, style, noscript, template
and comments never count.  A page is read whole, however long; an empty table gives no rows, and other columns are ignored, whatever
their names.  Hosts are compared in lower case without port.
A page without a host (null or malformed url) is merged with none and loses
nothing.  Repeated pages count as pages each.  Broken markup is closed as
browsers do it for paragraphs, list items and table cells; below ``DEEPEST``
levels nesting is flattened.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix
from ._util import checkpointed, documents, fresh

GAMMA = 0.9
#: A leaf goes if its features are on more than about m ** (1 - THRESHOLD) of a host's m pages.
THRESHOLD = 0.6
DEEPEST = 200
#: Sets of at most this many keys are sent to the tasks; larger ones take joins.
SENT_KEYS = 2_000_000
_MASK = (1 << 64) - 1
_GOLD = 0x9E3779B97F4A7C15

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*+>?|([^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("p div ul ol dl table article section aside header footer nav main h1 h2 h3 h4 h5 h6 form pre blockquote hr figure fieldset address".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, **{t: {"p"} for t in _ENDS_P}, "body": {"head"}}
_SCOPE = frozenset("ul ol dl table article section aside header footer nav main div body html form blockquote".split())


class Node:
    __slots__ = ("tag", "label", "href", "kids", "text")

    def __init__(self, tag: str, label: str, href: str = "", text: str = ""):
        self.tag, self.label, self.href, self.text, self.kids = tag, label, href, text, []


def parse(page: str) -> Node:
    """The DOM of a page, text in ``#text`` nodes."""
    root = Node("#root", "#root")
    stack = [root]
    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            t = m[5]
            if t is not None:
                kids = stack[-1].kids
                if kids and kids[-1].tag == "#text":
                    kids[-1].text += t
                elif t.strip():
                    kids.append(Node("#text", "#text", "", t))
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        label, href = tag, ""
        if m[4]:
            for a in _ATTR.finditer(m[4]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "href":
                    href = value
                else:
                    label += f" {a[1].lower()}={value}"
        node = Node(tag, label, href)
        stack[-1].kids.append(node)
        if tag not in _VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def host_of(url: str | None) -> str | None:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#\s]+)", url or "")
    return m[1].lower().rstrip(".") if m else None


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def kid_key(style: int, nth: int) -> int:
    """Key of the nth child under a style."""
    return _mix((style + (nth + 1) * _GOLD) & _MASK)


def _kid_keys(style: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(style + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))


def walk(root: Node, host: str) -> Iterator[tuple[Node, int, int, int | None, int]]:
    """(node, key, style above, own style or None for a leaf, depth), parents first."""
    todo = [(root, xxhash.xxh64_intdigest(host), 0, 0)]
    while todo:
        node, key, above, depth = todo.pop()
        kids = node.kids
        if not kids or node.tag != "#root" and all(k.tag == "#text" for k in kids):
            yield node, key, above, None, depth
            continue
        style = xxhash.xxh64_intdigest("\x1f".join([k.label for k in kids]), key)
        yield node, key, above, style, depth
        for i, k in enumerate(kids):
            todo.append((k, kid_key(style, i), style, depth + 1))


def _features(node: Node) -> list[int]:
    text = node.text + " ".join(k.text for k in node.kids)
    out = [xxhash.xxh64_intdigest(s) for x in _SENTENCE.findall(text) if (s := x.strip())]
    if node.href:
        out.append(xxhash.xxh64_intdigest(node.href, 1))
    return out


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _pages(b: pa.RecordBatch) -> Iterator[tuple[int, str, Node]]:
    for i, (u, h) in enumerate(zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True)):
        if h and (host := host_of(u)) is not None:
            yield i, host, parse(h)


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: dict[tuple, int] = {}
        for _, host, root in _pages(b):
            h = xxhash.xxh64_intdigest(host)
            for node, key, _, style, depth in walk(root, host):
                if style is not None:
                    r = (h, key, style, len(node.kids), depth)
                    rows[r] = rows.get(r, 0) + 1
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(_signed(c) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(list(rows.values()), pa.int64())], ["host", "node", "style", "kids", "depth", "pages"])


def _leaves(shared: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else set(shared.view(np.uint64).tolist())
        for b in batches:
            out: list[tuple] = []
            for _, host, root in _pages(b):
                h = xxhash.xxh64_intdigest(host)
                for node, key, above, style, _ in walk(root, host):
                    if style is None and (known is None or above in known):
                        count: dict[int, int] = {}
                        for f in _features(node):
                            count[f] = count.get(f, 0) + 1
                        out += [(h, above, key, f, n) for f, n in count.items()]
            if out:
                cols = list(zip(*out, strict=True))
                f = np.array(cols[4], np.float64)
                yield pa.RecordBatch.from_arrays([*(_signed(c) for c in cols[:4]), pa.array(f.astype(np.int64)), pa.array(np.rint(f * np.log(f) * 1e6).astype(np.int64))], ["host", "style", "node", "feature", "f", "g"])

    return run


def _worth(leaf: tuple[int, float], pages: int) -> float:
    """Importance of a shared leaf on a host of so many pages."""
    count, nats = leaf
    return max(0.0, 1 - nats / math.log(pages) / count)


def host_pages(styles: dict[int, list[tuple[int, int, int, int]]]) -> int:
    """Pages of the host; all have the root, so no node is on more."""
    return max((sum(s[3] for s in own) for own in styles.values()), default=0)


def importance(styles: dict[int, list[tuple[int, int, int, int]]], leaf: dict[int, tuple[int, float]], gamma: float = GAMMA) -> tuple[dict[int, float], dict[int, float]]:
    """(importance, greatest importance in the branch) of each shared inner node.

    ``styles``: of each inner node its (style, children, depth, pages), also those of one page; ``leaf``: of each shared leaf
    with features their number and the sum of their entropies in nats.  What isn't here belongs to one page and is worth 1,
    but for a shared leaf without features, which is worth 0.
    """
    imp: dict[int, float] = {}
    top: dict[int, float] = {}
    pages = host_pages(styles)
    for key in sorted(styles, key=lambda k: -styles[k][0][2]):
        own = styles[key]
        m = sum(s[3] for s in own)
        if m < 2:
            imp[key] = top[key] = 1.0
            continue
        entropy, below, high = 0.0, 0.0, 0.0
        for style, kids, _, n in own:
            p = n / m
            entropy -= p * math.log(p) / math.log(m)
            if n < 2:
                below += p
                high = 1.0
                continue
            total = 0.0
            for i in range(kids):
                k = kid_key(style, i)
                if k in imp:
                    x, t = imp[k], top[k]
                elif k in leaf:
                    x = t = _worth(leaf[k], pages)
                else:
                    x = t = 0.0
                total += x
                high = max(high, t)
            below += p * total / max(1, kids)
        g = gamma ** len(own)
        imp[key] = (1 - g) * max(0.0, entropy) + g * below
        top[key] = max(imp[key], high)
    return imp, top


def _noise(threshold: float, gamma: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        cols = {n: group[n].to_numpy() for n in ("node", "style", "kids", "depth", "pages", "nats", "is_leaf")}
        node = cols["node"].view(np.uint64).tolist()
        style = cols["style"].view(np.uint64).tolist()
        styles: dict[int, list] = {}
        leaf: dict[int, tuple] = {}
        for i, is_leaf in enumerate(cols["is_leaf"].tolist()):
            if is_leaf:
                leaf[node[i]] = (int(cols["pages"][i]), float(cols["nats"][i]))
            else:
                styles.setdefault(node[i], []).append((style[i], int(cols["kids"][i]), int(cols["depth"][i]), int(cols["pages"][i])))
        for k in styles:
            styles[k].sort()
        _, top = importance(styles, leaf, gamma)
        pages = host_pages(styles)
        noisy: list[int] = []
        todo = [k for k, s in styles.items() if s[0][2] == 0]
        while todo:  # the highest nodes of noisy branches
            k = todo.pop()
            if top.get(k, 1.0) < threshold:
                noisy.append(k)
                continue
            for s, kids, _, n in styles[k]:
                if n < 2:
                    continue
                for i in range(kids):
                    c = kid_key(s, i)
                    if c in styles:
                        todo.append(c)
                    elif c in leaf and _worth(leaf[c], pages) < threshold:
                        noisy.append(c)
        return pa.table({"host": pa.array([group["host"][0].as_py()] * len(noisy), pa.int64()), "node": _signed(noisy)})

    return run


def noisy_nodes(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """(host, node): the highest nodes of the branches to remove; host and node are hashes."""
    spark = pages.sparkSession
    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    styles = checkpointed(rows.mapInArrow(_styles, "host long, node long, style long, kids int, depth int, pages long").groupBy("host", "node", "style", "kids", "depth").agg(F.sum("pages").alias("pages")))
    shared = styles.where("pages > 1").select("style")
    few = shared.count() <= SENT_KEYS
    held = spark.sparkContext.broadcast(np.sort(shared.toArrow()["style"].to_numpy().astype(np.int64)) if few else None)
    leaves = rows.mapInArrow(lambda it: _leaves(held.value)(it), "host long, style long, node long, feature long, f long, g long")
    if not few:
        leaves = leaves.join(shared.distinct(), "style", "left_semi")
    each = leaves.groupBy("host", "node", "feature").agg(F.sum("f").cast("double").alias("f"), (F.sum("g") / 1e6).alias("g"))
    leaf = each.groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.ln("f") - F.col("g") / F.col("f")).alias("nats"))
    # an inner node of one page is worth 1 and needs no row; one of many pages keeps all its styles
    kept = styles.join(styles.groupBy("host", "node").agg(F.sum("pages").alias("m")).where("m > 1").select("host", "node"), ["host", "node"])
    both = kept.select("host", "node", "style", "kids", "depth", "pages", F.lit(0.0).alias("nats"), F.lit(False).alias("is_leaf")).unionByName(
        leaf.select("host", "node", F.lit(0).cast("long").alias("style"), F.lit(0).alias("kids"), F.lit(0).alias("depth"), "pages", "nats", F.lit(True).alias("is_leaf"))
    )
    return checkpointed(both.groupBy("host").applyInArrow(_noise(threshold, gamma), "host long, node long"))


def text_of(root: Node, host: str | None, noisy) -> tuple[str, int]:
    """(text of the page without the noisy branches, number of branches removed)."""
    keys: dict[int, int] = {}
    removed = 0
    if host is not None and noisy:
        keys = {id(n): k for n, k, *_ in walk(root, host)}
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if keys and keys.get(id(n)) in noisy:
            removed += 1
            continue
        if n.tag == "#text":
            out.append(entities.unescape(n.text))
            continue
        block = n.tag not in _INLINE and n.tag != "#root"
        if block:
            out.append("\n")
            todo.append("\n")
        todo.extend(reversed(n.kids))
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), removed


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """(page_id, text, n_removed) of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    noisy = noisy_nodes(pages, threshold, gamma)
    key = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    few = noisy.count() <= SENT_KEYS
    held = spark.sparkContext.broadcast(noisy.select("node").toArrow()["node"].to_numpy().astype(np.int64) if few else None)
    if not few:  # each page gets its host's nodes; adaptive execution splits hot hosts
        per = noisy.groupBy(F.col("host").alias(h := fresh("host"))).agg(F.collect_list("node").alias("noisy"))

        @F.arrow_udf("long")
        def host_hash(urls: pa.Array) -> pa.Array:
            return pa.array([None if (x := host_of(u)) is None else int(np.uint64(xxhash.xxh64_intdigest(x)).astype(np.int64)) for u in urls.to_pylist()], pa.int64())

        rows = rows.withColumn(h, host_hash("url")).join(per, h, "left").drop(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = None if held.value is None else set(held.value.view(np.uint64).tolist())
        for b in batches:
            text, n = [], []
            own = b["noisy"].to_pylist() if sent is None else [None] * b.num_rows
            for u, page, mine in zip(b["url"].to_pylist(), b["html"].to_pylist(), own, strict=True):
                if page is None:
                    text.append(None)
                    n.append(0)
                    continue
                t, k = text_of(parse(page), host_of(u), sent if sent is not None else {x & _MASK for x in mine or ()})
                text.append(t)
                n.append(k)
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(text, pa.string()), pa.array(n, pa.int32())], ["page_id", "text", "n_removed"])

    return rows.mapInArrow(run, f"page_id {key}, text string, n_removed int")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extract(documents(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_html": op2_html}
