"""All registered queries."""

from threadloom.plans import aggregates, changes, filters, grouping, queries, retrieval, scalars, sources  # noqa: F401
from threadloom.plans.registry import CATALOG

__all__ = ["CATALOG"]
