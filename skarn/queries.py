"""All queries of the library; importing a module of queries registers them."""

from __future__ import annotations

from .plans import graph_queries, logic_queries, market_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
