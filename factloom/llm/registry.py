"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from . import ann, bpe, html, licenses, mixing, neardup, packing, pii, topk, toxicity

MODULES = [bpe, html, mixing, packing, ann, toxicity, licenses, topk, pii, neardup]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
