"""Informed model: vocabulary detector and strategy, planned before any row is scored.

The detector reads only words and labels, never predictions. So all checks, rate changes and
rebuilds of a stream are known before scoring, and the model is a table of segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import bayes, strategies, vocabulary
from driftloom.operators.prefix import BLOCK_ROWS
from driftloom.session import cut


@dataclass
class InformedPlan:
    checks: DataFrame
    events: DataFrame
    rates: DataFrame
    segments: DataFrame


def extent_of(instances: DataFrame) -> DataFrame:
    return instances.groupBy("stream", "seed").agg((F.max("idx") + 1).alias("n"))


def plan(instances: DataFrame, specs: DataFrame) -> InformedPlan:
    """Checks, events, rate trace and segments of every informed cell.

    `instances` is a table with word bags; `specs` has one row per (stream, seed, model).
    """
    seen = cut(vocabulary.window_words(instances, specs), "window-words")
    checks = vocabulary.detect(instances, specs, seen)
    rated = cut(strategies.rates(checks, specs), "rated-checks")
    return InformedPlan(
        checks=rated,
        events=strategies.vocabulary_events(rated),
        rates=strategies.rate_trace(rated, specs),
        segments=strategies.segments(rated, specs, extent_of(instances)),
    )


def run(instances: DataFrame, specs: DataFrame, block_rows: int = BLOCK_ROWS):
    """(predictions, plan) of informed models."""
    planned = plan(instances, specs)
    segments = cut(planned.segments, "segments")
    return bayes.predict(instances, segments, block_rows), planned
