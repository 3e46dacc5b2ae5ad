"""All registered queries."""

from quadrat.plans import queries_community, queries_shape, queries_tests  # noqa: F401
from quadrat.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
