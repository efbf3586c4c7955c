"""All queries of the engine and their DuckDB twins."""

from __future__ import annotations

from tapestream.plans import check_queries, more_queries, report_queries, research_queries, source_queries, time_queries, trading_queries  # noqa: F401
from tapestream.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
