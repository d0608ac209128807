"""All registered queries of the library."""

from . import metric_queries, operator_queries, reconcile_queries, run_queries, selection_queries, suite_queries, synthetic_queries, text_queries
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "metric_queries", "operator_queries", "reconcile_queries", "run_queries", "selection_queries", "suite_queries", "synthetic_queries", "text_queries"]
