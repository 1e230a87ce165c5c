"""All named queries, in one import."""

from evigraph.plans import q_files, q_graph, q_metrics, q_patterns, q_review  # noqa: F401
from evigraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
