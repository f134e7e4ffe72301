"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from tallyforge.plans import evaluation_queries, extraction_queries, financial_queries, text_queries, value_queries  # noqa: F401  (they register themselves)
from tallyforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
