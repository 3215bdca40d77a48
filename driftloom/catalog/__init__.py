"""All registered queries; each module adds its own."""

from driftloom.catalog import eval_queries, fusion_queries, grid_queries, live_queries, model_queries, store_queries, stream_queries, text_queries  # noqa: F401
from driftloom.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
