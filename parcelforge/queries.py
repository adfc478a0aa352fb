"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from parcelforge.plans import certificate_queries, document_queries, layout_queries, store_queries, text_queries  # noqa: F401  (they register themselves)
from parcelforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
