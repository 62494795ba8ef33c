"""Registered analyzers over a fact catalog; each gives diagnostics (analyzer, pos, message, category)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import FactCatalog

Analyzer = Callable[[FactCatalog], DataFrame]
_REGISTRY: dict[str, tuple[str, Analyzer]] = {}


def register(name: str, doc: str) -> Callable[[Analyzer], Analyzer]:
    """Add an analyzer; its rows are (pos, message, category)."""

    def add(f: Analyzer) -> Analyzer:
        _REGISTRY[name] = doc, f
        return f

    return add


def analyzers() -> list[tuple[str, str]]:
    """(name, what it finds) of all, by name."""
    return sorted((n, d) for n, (d, _) in _REGISTRY.items())


def analyze(catalog: FactCatalog, *names: str) -> DataFrame:
    """(analyzer, pos, message, category) of the named analyzers, of all without names; unknown names raise."""
    wanted = names or tuple(sorted(_REGISTRY))
    unknown = [n for n in wanted if n not in _REGISTRY]
    if unknown:
        raise KeyError(f"no analyzer {', '.join(unknown)}; there are {', '.join(sorted(_REGISTRY))}")
    return reduce(DataFrame.unionByName, [_REGISTRY[n][1](catalog).select(F.lit(n).alias("analyzer"), "pos", "message", "category") for n in wanted])


@register("selfcall", "functions that call themselves directly")
def _selfcall(c: FactCatalog) -> DataFrame:
    i = c.table("instr").where("tag = 'ssa-call' AND callee = func")
    return i.select("pos", F.concat("func", F.lit(" calls itself")).alias("message"), F.lit("recursion").alias("category"))


@register("uncalled", "unexported functions that no edge leads to")
def _uncalled(c: FactCatalog) -> DataFrame:
    called = c.table("cg_edge").select(F.col("callee").alias("func")).distinct()
    f = c.functions.where(F.col("short_name").rlike(r"^\p{Ll}") & ~F.col("short_name").isin("main", "init"))
    return f.join(called, "func", "left_anti").select("pos", F.concat("func", F.lit(" is never called")).alias("message"), F.lit("unused").alias("category"))


@register("lostblock", "blocks without predecessors that aren't an entry or a recover block")
def _lostblock(c: FactCatalog) -> DataFrame:
    b = c.table("block").where((F.col("idx") > 0) & (F.coalesce(F.size("preds"), F.lit(0)) <= 0) & ~F.coalesce("recover", F.lit(False)))
    return b.select(F.lit(None).cast("string").alias("pos"), F.concat("func", F.lit(": block "), F.col("idx").cast("string"), F.lit(" can't be reached")).alias("message"), F.lit("unreachable").alias("category"))
