"""All registered queries."""

from faultspark.plans import signal_queries
from faultspark.plans.registry import QUERIES, SQL

from faultspark.plans import locate_queries, other_queries, report_queries  # noqa: E402,F401

flagship = signal_queries.td_scored_query

__all__ = ["QUERIES", "SQL", "flagship"]
