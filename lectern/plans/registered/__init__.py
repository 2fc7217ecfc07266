"""All registered queries."""

from lectern.plans.registered import adhoc, graphs, passages, retrieval, tables, talks, texts  # noqa: F401
from lectern.plans.registered.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
