"""Site selectors: DataFrames of functions that beliefs are checked on.

Functions are rows (func, short_name, pkg, recv_type, ...) as in the ``func`` fact table; a receiver type may carry a leading ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import implementors
from .beliefs import all_of, has_receiver
from .paths import name_matches


def all_functions_in(funcs: DataFrame, *packages: str) -> DataFrame:
    """All functions, or those of the packages."""
    return funcs.where(F.col("pkg").isin(*packages)) if packages else funcs


def functions_matching(funcs: DataFrame, *predicates: Column) -> DataFrame:
    """Functions for which all predicates hold; NULL is no."""
    return funcs.where(all_of(*predicates))


def methods_of(funcs: DataFrame, part: str) -> DataFrame:
    """Functions whose receiver type contains ``part``."""
    return functions_matching(funcs, has_receiver("recv_type", part))


def callers_of(funcs: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Functions with an edge (src, dst) into ``name`` (short or qualified); callers without a function row are left out, each function is one site."""
    callers = edges.where(name_matches("dst", name)).select(F.col("src").alias("func")).distinct()
    return funcs.join(callers, "func", "left_semi")


def _receivers(funcs: DataFrame) -> DataFrame:
    return funcs.withColumn("impl_type", F.regexp_replace("recv_type", r"^\*", ""))


def implementors_of(funcs: DataFrame, methods: DataFrame, interfaces: DataFrame, name: str) -> DataFrame:
    """All methods of the types that have every method (type, method) of the interface ``name`` (iface, pkg, method); with ``impl_type``."""
    types = implementors(methods, interfaces, name).select(F.regexp_replace("type", r"^\*", "").alias("impl_type")).distinct()
    return _receivers(funcs).join(types, "impl_type", "left_semi")


def interface_methods(funcs: DataFrame, methods: DataFrame, interfaces: DataFrame, name: str, method: str | None = None) -> DataFrame:
    """Those methods of the implementors that the interface asks for, or only ``method``; with ``impl_type``."""
    own = implementors_of(funcs, methods, interfaces, name)
    if method is not None:
        return own.where(F.col("short_name") == method)
    full = F.concat_ws(".", "pkg", "iface")
    want = interfaces.where((F.col("iface") == name) | (full == name)).select(F.col("method").alias("short_name")).distinct()
    return own.join(want, "short_name", "left_semi")
