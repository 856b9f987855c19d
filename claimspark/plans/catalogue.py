"""All registered queries."""

from claimspark.plans import queries_claims, queries_history, queries_retrieval, queries_sources  # noqa: F401 - they register
from claimspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
