"""Whole jobs and the registered queries."""

from vantage.plans.registry import ORACLE, QUERIES
from vantage.plans import density_queries, listing_queries, source_queries  # noqa: F401  (register)

__all__ = ["ORACLE", "QUERIES"]
