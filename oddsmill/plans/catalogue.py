"""All registered queries; importing the modules registers what they define."""

from __future__ import annotations

from oddsmill.plans import gate_queries, ingest_queries, queries, selection_queries, signal_queries, stream_queries, table_queries  # noqa: F401
from oddsmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
