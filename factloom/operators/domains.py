"""Abstract domains and algebraic normal forms as column expressions and small kernels."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNS = ("neg", "zero", "pos")


def sign(value: Column) -> Column:
    """neg, zero, pos; bottom for NULL."""
    return F.when(value.isNull(), "bottom").when(value < 0, "neg").when(value > 0, "pos").otherwise("zero")


def sign_join(a: Column, b: Column) -> Column:
    return F.when(a == b, a).when(a == "bottom", b).when(b == "bottom", a).otherwise("top")


def sign_op(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul on signs; what can't be told is top."""
    known = F.when((a == "bottom") | (b == "bottom"), "bottom")
    if op == "sub":
        return sign_op("add", a, F.when(b == "neg", "pos").when(b == "pos", "neg").otherwise(b))
    if op == "add":
        return known.when(a == "zero", b).when(b == "zero", a).when((a == b) & (a != "top"), a).otherwise("top")
    if op == "mul":
        return known.when((a == "zero") | (b == "zero"), "zero").when((a == "top") | (b == "top"), "top").when(a == b, "pos").otherwise("neg")
    return known.otherwise("top")


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def interval_op(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul on intervals."""
    if op == "add":
        return interval(a["lo"] + b["lo"], a["hi"] + b["hi"])
    if op == "sub":
        return interval(a["lo"] - b["hi"], a["hi"] - b["lo"])
    if op != "mul":
        return interval(F.lit(float("-inf")), F.lit(float("inf")))
    p = [a[x] * b[y] for x in ("lo", "hi") for y in ("lo", "hi")]
    return interval(F.least(*p), F.greatest(*p))


def interval_join(a: Column, b: Column) -> Column:
    return interval(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def widen(old: Column, new: Column) -> Column:
    """Bounds that still move go to infinity."""
    return interval(F.when(new["lo"] < old["lo"], F.lit(float("-inf"))).otherwise(old["lo"]), F.when(new["hi"] > old["hi"], F.lit(float("inf"))).otherwise(old["hi"]))


def constant(text: Column) -> Column:
    """3 of ``3:int``; NULL for what isn't an integer constant."""
    return F.regexp_extract(text, r"^(-?[0-9]+):u?int(8|16|32|64|ptr)?$", 1).try_cast("long")


def fold(op: Column, x: Column, y: Column) -> Column:
    """Value of a binary operation on 64-bit constants; division truncates; NULL where unknown or beyond 64 bits."""
    safe = F.when((y != 0) & ~((y == -1) & (x == F.lit(-(1 << 63)))), y)
    return F.when(op == "+", F.try_add(x, y)).when(op == "-", F.try_subtract(x, y)).when(op == "*", F.try_multiply(x, y)).when(op == "/", F.call_function("div", x, safe)).when(op == "%", F.try_mod(x, F.when(y != 0, y)))


def normalize(op: Column, x: Column, y: Column, integer: Column) -> Column:
    """(op, x, y) after the first rule that applies: identity, annihilation, idempotence (integers), commutation.

    ``copy`` with the operand, or ``const`` with the value, stands for what needs no operation.
    """
    zero, one = F.lit("0"), F.lit("1")
    e = lambda o, a, b=None: F.struct(F.lit(o).alias("op") if isinstance(o, str) else o.alias("op"), a.alias("x"), (F.lit(None).cast("string") if b is None else b).alias("y"))
    rules = (
        F.when(integer & op.isin("+", "|", "^") & (y == zero), e("copy", x))
        .when(integer & op.isin("+", "|", "^") & (x == zero), e("copy", y))
        .when(integer & (op == "*") & (y == one), e("copy", x))
        .when(integer & (op == "*") & (x == one), e("copy", y))
        .when(integer & op.isin("*", "&") & ((x == zero) | (y == zero)), e("const", zero))
        .when(integer & op.isin("&", "|") & (x == y), e("copy", x))
        .when(op.isin("+", "*", "&", "|", "^", "==", "!="), e(op, F.least(x, y), F.greatest(x, y)))
    )
    return rules.otherwise(e(op, x, y))


# Boolean terms: strings, or tuples of and, or, not


def simplify(t):
    """Normal form under AC, idempotence, absorption, double negation, De Morgan, complement; no distribution."""
    if isinstance(t, (str, bool)):
        return t
    op, *args = t
    if op == "not":
        a = simplify(args[0])
        if isinstance(a, bool):
            return not a
        if isinstance(a, tuple) and a[0] == "not":
            return a[1]
        if isinstance(a, tuple) and a[0] in ("and", "or"):
            return simplify(("or" if a[0] == "and" else "and", *[("not", x) for x in a[1:]]))
        return ("not", a)
    unit = op == "and"
    flat: set = set()
    for a in map(simplify, args):
        if a is (not unit):
            return not unit
        if a is unit:
            continue
        flat |= set(a[1:]) if isinstance(a, tuple) and a[0] == op else {a}
    if any(simplify(("not", a)) in flat for a in flat if not (isinstance(a, tuple) and a[0] in ("and", "or"))):
        return not unit
    other = "or" if op == "and" else "and"
    kept = [a for a in flat if not (isinstance(a, tuple) and a[0] == other and set(a[1:]) & (flat - {a}))]
    if not kept:
        return unit
    return kept[0] if len(kept) == 1 else (op, *sorted(kept, key=repr))


def equivalent(a, b) -> bool:
    return simplify(a) == simplify(b)


@dataclass(frozen=True)
class Selector:
    """all-of, any-of, none-of over selectors or names."""

    kind: str
    parts: tuple

    def term(self):
        if not self.parts:
            raise ValueError(f"empty {self.kind}")
        inner = [p.term() if isinstance(p, Selector) else p for p in self.parts]
        if self.kind == "none-of":
            return ("not", inner[0] if len(inner) == 1 else ("or", *inner))
        return inner[0] if len(inner) == 1 else ("and" if self.kind == "all-of" else "or", *inner)


def condition(text: str):
    """Term of a condition with ``&&``, ``||``, ``!`` and parentheses; comparisons stay opaque."""
    tokens = re.findall(r"&&|\|\||!(?!=)|[()]|(?:[^&|!()]|!=|&(?!&)|\|(?!\|))+", text)
    tokens = [t.strip() for t in tokens if t.strip()]
    at = 0

    def atom():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("condition ends early")
        t = tokens[at]
        at += 1
        if t == "!":
            return ("not", atom())
        if t == "(":
            inner = either()
            at += 1
            return inner
        return t

    def both():
        nonlocal at
        parts = [atom()]
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def either():
        nonlocal at
        parts = [both()]
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    return either()


RULES = ("identity", "annihilation", "idempotence", "absorption", "associativity", "commutative")
_COMMUTES = ("+", "*", "&", "|", "^")


def normal_term(t, rules: tuple[str, ...] = RULES):
    """Normal form of an integer term, a name, a number or (op, x, y), by the chosen rules: x & (x | y) is x, sums and products are flat and in order."""
    if not isinstance(t, tuple):
        return t
    op, *args = t
    args = [normal_term(a, rules) for a in args]
    if "associativity" in rules and op in _COMMUTES:
        args = [b for a in args for b in (a[1:] if isinstance(a, tuple) and a[0] == op else (a,))]
    if "annihilation" in rules and op in ("*", "&") and 0 in args:
        return 0
    if "identity" in rules:
        unit = {"+": 0, "|": 0, "^": 0, "*": 1}.get(op)
        if unit is not None:
            args = [a for a in args if a != unit or isinstance(a, bool)] or [unit]
        elif op == "-" and len(args) == 2 and args[1] == 0:
            return args[0]
    if "idempotence" in rules and op in ("&", "|"):
        args = list(dict.fromkeys(args))
    if "absorption" in rules and op in ("&", "|"):
        other = "|" if op == "&" else "&"
        args = [a for a in args if not (isinstance(a, tuple) and a[0] == other and any(b in a[1:] for b in args if b is not a))]
    if len(args) == 1 and op in _COMMUTES:
        return args[0]
    if "commutative" in rules and op in (*_COMMUTES, "==", "!="):
        args.sort(key=repr)
    return (op, *args)


def solve(blocks: dict[int, list[int]], transfer, join, bottom, entry=None, start: int = 0, widening=None, patience: int = 3) -> dict[int, tuple]:
    """Worklist solution {block: (in, out)} for successor lists; ``widening`` applies after ``patience`` visits of a block."""
    before: dict = {b: [] for b in blocks}
    for p, ss in blocks.items():
        for b in ss:
            before[b].append(p)
    state = {b: (bottom, bottom) for b in blocks}
    visits = dict.fromkeys(blocks, 0)
    work = deque(sorted(blocks))
    while work:
        b = work.popleft()
        into = entry if b == start and entry is not None else bottom
        for p in before[b]:
            into = join(into, state[p][1])
        visits[b] += 1
        if widening is not None and visits[b] > patience:
            into = widening(state[b][0], into)
        out = transfer(b, into)
        if visits[b] == 1 or (into, out) != state[b]:
            changed = out != state[b][1] or visits[b] == 1
            state[b] = (into, out)
            if changed:
                work += [s for s in blocks[b] if s not in work]
    return state
