"""All registered queries of the agent's analytics."""

from ledgerlens.plans import decision_queries, lookup_queries, metric_queries, quality_queries, retrieval_queries, scenario_queries, store_queries, stream_queries, trace_queries, voice_queries  # noqa: F401
from ledgerlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
