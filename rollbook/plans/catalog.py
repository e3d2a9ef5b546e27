"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    dashboard_queries,
    document_queries,
    eligibility_queries,
    graph_queries,
    question_queries,
    registry_queries,
    rule_queries,
    sink_queries,
)
from .base import QUERIES, comparison_sql

__all__ = ["QUERIES", "comparison_sql"]
