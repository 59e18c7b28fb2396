"""All registered queries of the engine's own operators."""

from loomstone.plans import decision_queries, graph_queries, log_queries, rule_queries, scan_queries, source_queries  # noqa: F401
from loomstone.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
