"""A grid run: stream rows, drifts and specs in; predictions, events, rates, windows and metrics rows out.

Every kind of model runs on the same instances table. Models count rows, so rows are numbered from 0 within each stream
first; a slice or a stream with holes runs like any other, and `at` keeps the rows' own numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import bayes
from driftloom.operators.prefix import BLOCK_ROWS
from driftloom.operators.sampling import ordinal_by_index
from driftloom.plans import enhanced, evaluate, informed
from driftloom.plans.specs import per_cell
from driftloom.session import cut

STREAM = ["stream", "seed"]
CELL = ["stream", "seed", "model"]
FIXED = ("accumulative", "fading")
#: Kinds of models without a detector.
BLIND = ("majority", *FIXED)
#: Measured cost of a cell.
COSTS = ("throughput", "batch_ms_p50", "batch_ms_p95")
PREDICTION = [*CELL, "idx", "label", "pred", "lam", "entries"]
EVENT = [*CELL, "idx", "detector", "kind", "acted", "rebuild_size"]


@dataclass
class Grid:
    predictions: DataFrame
    events: DataFrame
    rates: DataFrame
    windows: DataFrame
    metrics: DataFrame


def positioned(instances: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Instances whose idx is the position in the run; `at` is the number they came with."""
    return cut(ordinal_by_index(instances, STREAM, "position", block_rows).withColumnRenamed("idx", "at").withColumnRenamed("position", "idx"), "positioned")


def predictions(instances: DataFrame, specs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, events, rates) of every cell of `specs`, whatever its kind; positions from 0 on."""
    kinds = {r["kind"] for r in specs.select("kind").distinct().collect()}  # five at most
    found, events, rates = [], [], []
    learned = (F.col("entries") + F.col("new_entries")).cast("long").alias("entries")
    if "majority" in kinds:
        cells = specs.where("kind = 'majority'").select(*CELL)
        found.append(bayes.majority(instances, block_rows).join(cells, STREAM).select(
            *CELL, "idx", "label", "pred", F.lit(0.0).alias("lam"), F.lit(0).cast("long").alias("entries")))
    # fixed and informed models are known before a row is scored: one pass over all their segments
    segments = []
    if kinds & set(FIXED):
        cells = specs.where(F.col("kind").isin(*FIXED))
        ends = instances.groupBy(*STREAM).agg(F.max("idx").alias("hi"))
        segments.append(cells.join(ends, STREAM).select(*CELL, F.lit(0).cast("long").alias("b"), "lam", "alpha", F.lit(0).cast("long").alias("lo"), "hi"))
    if "informed" in kinds:
        planned = informed.plan(instances, cut(specs.where("kind = 'informed'"), "specs"))
        segments.append(planned.segments)
        events.append(planned.events.select(*EVENT))
        rates.append(planned.rates.select(*CELL, "idx", "lam"))
    if segments:
        planned = cut(reduce(DataFrame.unionByName, segments), "segments")
        found.append(bayes.predict(instances, planned, block_rows).select(*PREDICTION[:-1], learned))
    if "enhanced" in kinds:
        run = enhanced.run(instances, specs.where("kind = 'enhanced'"), block_rows)
        found.append(run.predictions.select(*PREDICTION[:-1], learned))
        events.append(run.events.select(*EVENT))
        rates.append(run.rates.select(*CELL, "idx", "lam"))
    none = specs.sparkSession.createDataFrame([], "stream string, seed int, model string, idx long, detector string, kind string, acted boolean, rebuild_size long")
    steady = specs.where(F.col("kind").isin(*BLIND)).select(*CELL, F.lit(0).cast("long").alias("idx"), "lam")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, events, none), reduce(DataFrame.unionByName, rates, steady)


def drift_positions(instances: DataFrame, drifts: DataFrame) -> DataFrame:
    """Drifts by position: the rows of the run before them. Drifts are a handful of rows for each stream."""
    natural = "natural" in drifts.columns
    keys = [*STREAM, "p", "e", *(["natural"] if natural else [])]
    before = {c: F.count_if(F.col("at") < F.col(c)).alias(f"_{c}") for c in keys[2:]}
    counted = instances.select(*STREAM, "at").join(drifts.select(*keys), STREAM).groupBy(*keys).agg(*before.values())
    kept = [F.when(F.col(c).isNotNull(), F.col(f"_{c}")).alias(c) for c in keys[2:]]
    return counted.select(*STREAM, *kept)


def described(metrics: DataFrame, cells: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Metrics rows with the settings that tell their models apart, and with measured cost.

    A setting that a kind of model does not have is NULL. `costs` has stream, seed, model and COSTS, from the progress of
    live runs (see `evaluate.cost_summary`); without it, or for cells that it lacks, cost is NULL.
    """
    adaptive = F.col("kind") == "enhanced"
    reads_words = (F.col("kind") == "informed") | (adaptive & (F.col("fusion") != "adwin_only"))
    settings = cells.select(
        *CELL, "kind", F.when(adaptive, F.col("fusion")).alias("fusion"), F.when(adaptive & (F.col("fusion") != "vocab_only"), F.col("adwin_delta")).alias("adwin_delta"),
        F.when(reads_words, F.col("detect_alpha")).alias("detect_alpha"))
    out = metrics.join(settings, CELL)
    if costs is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in COSTS})
    return out.join(costs.select(*CELL, *COSTS), CELL, "left")


def run(instances: DataFrame, specs: DataFrame, drifts: DataFrame, tolerance: int, recovery_window: int, window: int,
        block_rows: int = BLOCK_ROWS, costs: DataFrame | None = None) -> Grid:
    """All cells of (streams of `instances`) x (rows of `specs`, see `specs.spec_table`), evaluated against `drifts`."""
    rows = positioned(instances, block_rows)
    cells = cut(per_cell(specs, rows), "specs")
    found, events, rates = predictions(rows.drop("at"), cells, block_rows)
    found, events = cut(found, "predictions"), cut(events, "events")
    places = cut(drift_positions(rows, drifts), "drifts")
    blind = tuple(r["model"] for r in cells.where(F.col("kind").isin(*BLIND)).select("model").distinct().collect())
    sizes = found.groupBy(*CELL).agg(F.max_by("entries", "idx").alias("model_entries"))
    metrics = evaluate.metrics_row(found, events, places, tolerance, recovery_window, sizes, block_rows, blind)
    own = rows.select(*STREAM, "idx", "at")
    return Grid(
        predictions=found.join(own, [*STREAM, "idx"]), events=events.join(own, [*STREAM, "idx"]), rates=rates,
        windows=evaluate.windowed_accuracy(found, CELL, window), metrics=described(metrics, cells, costs))
