"""evigraph: evidence-graph analytics expressed as Spark DataFrame jobs."""

from evigraph.operators.graph import EvidenceGraph

__all__ = ["EvidenceGraph"]
