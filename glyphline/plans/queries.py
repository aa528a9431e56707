"""All registered queries."""

from . import q_filters, q_functions, q_joins, q_aggregates, q_sequences, q_dedupe, q_text, q_budget, q_runs  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
