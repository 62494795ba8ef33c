"""Per-function analyses: one function's blocks and instructions fit a worker, functions spread over the cluster.

Each takes tables with a ``func`` column, gathers one row for each function (partial lists are built before the shuffle) and
runs a worklist over Arrow batches of functions.  A function's graph is bounded by what a person writes; graphs that grow with
the data belong to :mod:`.paths` and :mod:`.flows`.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .domains import solve

_TOP = "top"
_INF = float("inf")


def per_function(kernel: Callable[..., list], returns: str, *tables: DataFrame) -> DataFrame:
    """(func, fields of ``returns``) of the tuples that ``kernel`` gives for the rows (as dicts) of a function in each table."""
    spark = tables[0].sparkSession
    joined = None
    for i, t in enumerate(tables):
        rows = t.groupBy("func").agg(F.collect_list(F.struct(*[c for c in t.columns if c != "func"])).alias(f"t{i}"))
        joined = rows if joined is None else joined.join(rows, "func", "full")
    out = spark.createDataFrame([], f"x array<struct<{returns}>>").schema["x"].dataType
    arrow = to_arrow_type(out)
    names = out.elementType.fieldNames()

    @F.arrow_udf(out)
    def run(*columns: pa.Array) -> pa.Array:
        lists = zip(*[c.to_pylist() for c in columns], strict=True)
        return pa.array([[dict(zip(names, r, strict=True)) for r in kernel(*[x or [] for x in row])] for row in lists], arrow)

    return joined.select("func", F.explode(run(*[F.col(f"t{i}") for i in range(len(tables))])).alias("r")).select("func", "r.*")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# Dominance


def _idoms(edges: list[dict], entry) -> dict:
    """Immediate dominator of each node that the entry reaches; the entry's is itself."""
    after, before = defaultdict(list), defaultdict(list)
    for e in edges:
        after[e["src"]].append(e["dst"])
        before[e["dst"]].append(e["src"])
    order, seen, stack = [], {entry}, [(entry, iter(after[entry]))]
    while stack:  # post-order, without recursion
        node, rest = stack[-1]
        for x in rest:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(after[x])))
                break
        else:
            order.append(node)
            stack.pop()
    place = {x: i for i, x in enumerate(order)}
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for x in reversed(order[:-1]):
            new = None
            for p in before[x]:
                if p in idom:
                    if new is None:
                        new = p
                        continue
                    a, b = p, new
                    while a != b:
                        while place[a] < place[b]:
                            a = idom[a]
                        while place[b] < place[a]:
                            b = idom[b]
                    new = a
            if idom.get(x) != new:
                idom[x] = new
                changed = True
    return idom


def idoms(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(func, node, idom) of the blocks that the one entry (func, node) of each function reaches along (func, src, dst), but for the entry."""
    kind = _kind(entries, "node")

    def kernel(e: list[dict], n: list[dict]) -> list:
        return [(x, d) for x, d in _idoms(e, n[0]["node"]).items() if x != d] if n else []

    return per_function(kernel, f"node {kind}, idom {kind}", edges.select("func", "src", "dst"), entries.select("func", "node"))


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(func, node, dominator): the chains of :func:`idoms`; a node dominates itself."""
    kind = _kind(entries, "node")

    def kernel(e: list[dict], n: list[dict]) -> list:
        out = []
        if n:
            idom = _idoms(e, n[0]["node"])
            for x in idom:
                d = x
                while True:
                    out.append((x, d))
                    if d == idom[d]:
                        break
                    d = idom[d]
        return out

    return per_function(kernel, f"node {kind}, dominator {kind}", edges.select("func", "src", "dst"), entries.select("func", "node"))


def broken_dominance(blocks: DataFrame) -> DataFrame:
    """(func) whose idom chains (func, block, idom) don't all end in a block without one: dominance can't be told there."""

    def kernel(rows: list[dict]) -> list:
        up = {r["block"]: r["idom"] for r in rows}
        for x in up:
            seen = set()
            while x is not None:
                if x in seen or x not in up:
                    return [(True,)]
                seen.add(x)
                x = up[x]
        return []

    return per_function(kernel, "broken boolean", blocks.select("func", "block", "idom")).select("func")


# Sets of names


def gen_kill(edges: DataFrame, gen: DataFrame, kill: DataFrame, forward: bool = True) -> DataFrame:
    """(func, block, name): names that enter a block (``forward``) or are live on its entry, over edges (func, src, dst).

    Forward: in = union of the predecessors' (in - kill) | gen.  Backward: in = gen | (union of the successors' in) - kill.
    """
    block, name = _kind(gen, "block"), _kind(gen, "name")

    def kernel(e: list[dict], g: list[dict], k: list[dict]) -> list:
        make, stop, after, before = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
        for r in g:
            make[r["block"]].add(r["name"])
        for r in k:
            stop[r["block"]].add(r["name"])
        for r in e:
            a, b = (r["src"], r["dst"]) if forward else (r["dst"], r["src"])
            after[a].add(b)
            before[b].add(a)
        state: dict = defaultdict(set)
        work = deque(sorted({*make, *after, *before}))
        queued = set(work)
        while work:
            b = work.popleft()
            queued.discard(b)
            if forward:
                into = {n for p in before[b] for n in (state[p] - stop[p]) | make[p]}
            else:
                into = make[b] | ({n for p in before[b] for n in state[p]} - stop[b])
            if into - state[b]:
                state[b] = state[b] | into
                for s in after[b] - queued:
                    work.append(s)
                    queued.add(s)
        return [(b, n) for b, ns in state.items() for n in ns]

    return per_function(kernel, f"block {block}, name {name}", edges.select("func", "src", "dst"), gen.select("func", "block", "name"), kill.select("func", "block", "name"))


# Values of registers


def _value(state: dict, x):
    if x is None:
        return _TOP
    head, _, kind = str(x).partition(":")
    if kind and head.lstrip("-").isdigit():
        return int(head)
    return state.get(x, _TOP)


def _fold(op, a, b):
    if a == _TOP or b == _TOP:
        return _TOP
    if op in ("/", "%") and b == 0:
        return _TOP
    q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if op in ("/", "%") else 0
    return {"+": a + b, "-": a - b, "*": a * b, "/": q, "%": a - q * b}.get(op, _TOP) if op in "+-*/%" else _TOP


def _join(a: dict, b: dict) -> dict:
    return {k: (a[k] if k in a and (k not in b or a[k] == b[k]) else b[k] if k not in a else _TOP) for k in {*a, *b}}


def _sign(v):
    return v if isinstance(v, str) else "neg" if v < 0 else "pos" if v > 0 else "zero"


def _sign_op(op, a, b):
    if op == "-":
        return _sign_op("+", a, {"neg": "pos", "pos": "neg"}.get(b, b))
    if op == "+":
        return b if a == "zero" else a if b == "zero" or a == b else _TOP
    if op == "*":
        return "zero" if "zero" in (a, b) else _TOP if _TOP in (a, b) else "pos" if a == b else "neg"
    return _TOP


def _blocks(ins: list[dict], edges: list[dict]) -> tuple[dict, dict]:
    """(successors of each block, instructions of each block in order)."""
    code, after = defaultdict(list), defaultdict(set)
    for r in sorted(ins, key=lambda r: (r["block"], r["ord"])):
        code[r["block"]].append((r["name"], r["op"], r["x"], r["y"]))
    for e in edges:
        after[e["src"]].add(e["dst"])
    ids = sorted({*code, *after, *(e["dst"] for e in edges)})
    return {b: sorted(after[b]) for b in ids}, code


_INS = ("func", "block", "ord", "name", "op", "x", "y")


def constants(instructions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func, name, value): constant of each register at its function's end, or ``top``.

    ``instructions`` (func, block, ord, name, op, x, y), ``blocks`` (func, src, dst); other operations are top.
    """

    def kernel(ins: list[dict], edges: list[dict]) -> list:
        succ, code = _blocks(ins, edges)

        def transfer(b, state):
            out = dict(state)
            for name, op, x, y in code[b]:
                if name is None:
                    continue
                if op == "phi":
                    vs = {_value(out, v) for v in (x, y) if v in out or _value({}, v) != _TOP}
                    out[name] = vs.pop() if len(vs) == 1 else _TOP
                else:
                    out[name] = _fold(op, _value(out, x), _value(out, y))
            return out

        last: dict = {}
        for _, out in solve(succ, transfer, _join, {}, {}, min(succ, default=0)).values():
            last = _join(last, out)
        return [(n, str(last[n])) for n in sorted(last)]

    return per_function(kernel, "name string, value string", instructions.select(*_INS), blocks.select("func", "src", "dst"))


def signs(instructions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func, name, sign): neg, zero, pos or top of each register at its function's end."""

    def kernel(ins: list[dict], edges: list[dict]) -> list:
        succ, code = _blocks(ins, edges)
        value = lambda state, v: _sign(_value(state, v))

        def transfer(b, state):
            out = dict(state)
            for name, op, x, y in code[b]:
                if name is None:
                    continue
                if op == "phi":
                    vs = {value(out, v) for v in (x, y) if v in out or _value({}, v) != _TOP}
                    out[name] = vs.pop() if len(vs) == 1 else _TOP
                else:
                    out[name] = _sign_op(op, value(out, x), value(out, y))
            return out

        last: dict = {}
        for _, out in solve(succ, transfer, _join, {}, {}, min(succ, default=0)).values():
            last = _join(last, out)
        return [(n, last[n]) for n in sorted(last)]

    return per_function(kernel, "name string, sign string", instructions.select(*_INS), blocks.select("func", "src", "dst"))


def intervals(instructions: DataFrame, blocks: DataFrame, patience: int = 3) -> DataFrame:
    """(func, name, lo, hi) of each register; bounds that still move after ``patience`` visits of a block go to infinity."""

    def value(state, x):
        v = _value({}, x)
        return (float(v), float(v)) if v != _TOP else state.get(x, (-_INF, _INF))

    def op_(op, a, b):
        if op == "+":
            return a[0] + b[0], a[1] + b[1]
        if op == "-":
            return a[0] - b[1], a[1] - b[0]
        if op == "*":
            p = [0.0 if 0 in (x, y) else x * y for x in a for y in b]
            return min(p), max(p)
        return -_INF, _INF

    def hull(a: dict, b: dict) -> dict:
        return {k: (min(a.get(k, b.get(k))[0], b.get(k, a.get(k))[0]), max(a.get(k, b.get(k))[1], b.get(k, a.get(k))[1])) for k in {*a, *b}}

    def widen(old: dict, new: dict) -> dict:
        return {k: (v if k not in old else (old[k][0] if v[0] >= old[k][0] else -_INF, old[k][1] if v[1] <= old[k][1] else _INF)) for k, v in new.items()}

    def kernel(ins: list[dict], edges: list[dict]) -> list:
        succ, code = _blocks(ins, edges)

        def transfer(b, state):
            out = dict(state)
            for name, op, x, y in code[b]:
                if name is None:
                    continue
                if op == "phi":
                    known = [value(out, v) for v in (x, y) if _value({}, v) != _TOP or v in out]
                    out[name] = (min(v[0] for v in known), max(v[1] for v in known)) if known else (-_INF, _INF)
                else:
                    out[name] = op_(op, value(out, x), value(out, y))
            return out

        last: dict = {}
        for _, out in solve(succ, transfer, hull, {}, {}, min(succ, default=0), widen, patience).values():
            last = hull(last, out)
        return [(n, *last[n]) for n in sorted(last)]

    return per_function(kernel, "name string, lo double, hi double", instructions.select(*_INS), blocks.select("func", "src", "dst"))
