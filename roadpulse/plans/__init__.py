"""Registered queries; importing this package fills the registry."""

from roadpulse.plans import evaluation_queries, feature_queries, insight_queries, learning_queries, live_queries, stream_queries  # noqa: F401
from roadpulse.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
