"""Registered queries over the given tables."""

from . import block_queries, governance_queries, index_queries, reconcile_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
