"""All registered queries."""

from paperloom.plans import document_queries, layout_queries, retrieval_queries, system_queries, text_queries
from paperloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "document_queries", "layout_queries", "retrieval_queries", "system_queries", "text_queries"]
