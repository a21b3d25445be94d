"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from quern.plans import change_queries, graph_queries, index_queries, lifecycle_queries, memory_queries, source_queries, state_queries, text_queries  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
