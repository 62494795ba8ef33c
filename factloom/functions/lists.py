"""List and tree utilities as column expressions and DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def take(arr: str, n: int) -> Column:
    """The first ``n`` elements; none for n <= 0."""
    return F.slice(arr, 1, max(0, n))


def drop(arr: str, n: int) -> Column:
    """What follows the first ``n`` elements."""
    return F.slice(arr, F.lit(max(0, n) + 1), F.greatest(F.size(arr) - max(0, n), F.lit(0)))


def member(arr: str, x) -> Column:
    return F.coalesce(F.array_contains(arr, x), F.lit(False))


def unique(arr: str) -> Column:
    """Distinct elements in the order of their first occurrence."""
    return F.array_distinct(arr)


def filter_map(arr: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the elements, without NULLs."""
    return F.filter(F.transform(arr, f), lambda x: x.isNotNull())


def flat_map(arr: str, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(arr, f))


def ordered_pairs(arr: str) -> Column:
    """Every pair (a, b) of elements once, a before b."""
    n = F.size(arr)
    tail = lambda i: F.slice(arr, i + 2, F.greatest(n - i - 1, F.lit(0)))
    return F.flatten(F.transform(arr, lambda x, i: F.transform(tail(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def index_of(text: str, part: str) -> Column:
    """Position from 0 of the first occurrence, NULL without one."""
    at = F.instr(text, part)
    return F.when(at > 0, at - 1)


def short_name(name: str) -> Column:
    return F.substring_index(name, ".", -1)


def walk(nodes: DataFrame, root: int) -> DataFrame:
    """A node (tree, id, path, ...) and its descendants in pre-order: paths that begin with its own."""
    top = nodes.where(F.col("id") == root).select(F.col("tree").alias("t"), F.col("path").alias("p"))
    inside = nodes.join(top, (F.col("tree") == F.col("t")) & (F.slice("path", F.lit(1), F.size("p")) == F.col("p")))
    return inside.drop("t", "p").orderBy("tree", "id")


def transform_nodes(nodes: DataFrame, where: Column, value: Column) -> DataFrame:
    """Nodes that match get a new value, and what was below them goes; a replacement isn't looked into."""
    hit = nodes.where(where).select(F.col("tree").alias("t"), F.col("path").alias("p"))
    below = (F.col("tree") == F.col("t")) & (F.size("path") > F.size("p")) & (F.slice("path", F.lit(1), F.size("p")) == F.col("p"))
    return nodes.withColumn("value", F.when(where, value).otherwise(F.col("value"))).join(hit, below, "left_anti")
