"""Registered query plans: each pairs a Spark query (library operators over
the fixture relations) with an independent DuckDB oracle SQL."""

from . import catalog_queries, graph_queries, lineage_queries, report_queries, stream_queries  # noqa: F401
from .common import REGISTRY

__all__ = ["REGISTRY"]
