"""Registered queries and their SQL."""

from __future__ import annotations

from . import code_queries, lexical_queries, module_queries, place_queries, relational_queries, retrieval_queries  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_docs"
