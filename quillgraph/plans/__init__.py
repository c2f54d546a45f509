"""Queries over the driver's tables. Importing this package registers all of them."""

from . import graph_queries, hierarchy_queries, store_queries, streaming_queries, telemetry_queries, text_queries, trend_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
