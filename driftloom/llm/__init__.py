"""Operators of a training-data pipeline, each a module with its query; nothing else in the library imports this package."""

from driftloom.llm import decontaminate, lines, minhash, negatives, packing, personal, phrases, pivots, quality, scoring, substrings, token_files, toxicity
from driftloom.llm.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "decontaminate", "lines", "minhash", "negatives", "packing", "personal", "phrases", "pivots", "quality", "scoring", "substrings", "token_files", "toxicity"]
