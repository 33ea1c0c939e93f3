"""All registered queries."""

from mnemolake.plans import analytics, building, ingestion, inspection, readers, retrieval, stored, streams  # noqa: F401
from mnemolake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
