"""All registered queries, grouped by operator family."""
from .registry import CHECKS, QUERIES
from . import comparison_queries, journal_queries, metric_queries, model_queries, signal_queries, source_queries  # noqa: F401
from .metric_queries import flagship

__all__ = ["CHECKS", "QUERIES", "flagship"]
