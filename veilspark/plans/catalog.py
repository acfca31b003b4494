"""All queries of the core."""

from __future__ import annotations

from veilspark.plans import scrub_queries, store_queries, tenancy_queries, text_queries
from veilspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "scrub_queries", "store_queries", "tenancy_queries", "text_queries"]
