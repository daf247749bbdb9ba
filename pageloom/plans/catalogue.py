"""All registered queries."""

from pageloom.plans import graph_queries, page_queries, ranking_queries, store_queries  # noqa: F401
from pageloom.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
