"""A sweep: every setting of detectors and fusions as a model of one grid run.

All settings share what they can: windows of words are read once, tracks of equal start and rate are scored once, and all
adaptive cells advance in the same rounds, so a sweep costs about as much as its most restless setting.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.prefix import BLOCK_ROWS
from driftloom.plans import grid, specs

#: Columns of a settings table that become parameters of the model.
PARAMETERS = ("model", "fusion", "adwin_delta", "detect_alpha")


def models_of(settings: DataFrame) -> dict[str, dict]:
    """Model settings by name; a NULL parameter keeps the default. Settings are a control table of a few dozen rows."""
    rows = settings.select("setting", *PARAMETERS).collect()
    return {r["setting"]: {k: r[k] for k in PARAMETERS if r[k] is not None} for r in rows}


def run(instances: DataFrame, settings: DataFrame, drifts: DataFrame, tolerance: int, recovery_window: int, window: int,
        params: Mapping | None = None, block_rows: int = BLOCK_ROWS, costs: DataFrame | None = None) -> grid.Grid:
    """The grid of all `settings` (see `report.sweep_settings`) on all streams; its metrics carry `setting`."""
    table = specs.spec_table(instances.sparkSession, models_of(settings), params)
    out = grid.run(instances, table, drifts, tolerance, recovery_window, window, block_rows, costs)
    out.metrics = out.metrics.withColumn("setting", F.col("model"))
    return out
