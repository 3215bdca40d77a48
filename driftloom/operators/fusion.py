"""Fusion of the vocabulary channel and the error channel.

    vocabulary  stream, seed, model, idx, signal, train_from   (one row per check)
    rises       stream, seed, model, idx, width                (rises of the error rate)

Both tables are a few rows per window; decisions are folds over their union, through the parts in `reactions`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.fold import ordered_fold
from driftloom.operators.reactions import HEARD, Channels
from driftloom.operators.vocabulary import CHANGE

CELL = ["stream", "seed", "model"]


def timeline(vocabulary: DataFrame, rises: DataFrame) -> DataFrame:
    """Both channels in processing order: at one row the error channel comes first."""
    checks = vocabulary.select(
        *CELL, "idx", F.lit(1).alias("turn"), F.lit("vocab").alias("detector"), "signal",
        "train_from", F.lit(None).cast("long").alias("width"))
    errors = rises.select(
        *CELL, "idx", F.lit(0).alias("turn"), F.lit("adwin").alias("detector"),
        F.lit("change").alias("signal"), F.lit(None).cast("long").alias("train_from"), "width")
    return checks.unionByName(errors)


def decide(signals: DataFrame, fusion: str, confirm_window: int, cooldown: int) -> DataFrame:
    """Add `gated`, the signal after fusion, and `acted`, a change that its channel's cooldown lets through.

    Folds the signals of a cell through the parts that the models use; both channels always react here.
    """
    known = [F.lit(c) for c in sorted(HEARD[fusion])]

    def start():
        channels = Channels(fusion, confirm_window, cooldown)

        def of(row) -> tuple[str, bool]:
            gated = channels.gate(row.detector, row.idx, row.signal)
            acted = gated == CHANGE and channels.rested(row.detector, row.idx)
            if acted:
                channels.rest(row.detector, row.idx)
            channels.note(row.detector, row.idx, row.signal)
            return gated, acted

        def step(batch: pd.DataFrame) -> pd.DataFrame:
            found = [of(row) for row in batch.itertuples()]
            return batch.assign(gated=[g for g, _ in found], acted=[a for _, a in found])[[*CELL, "detector", "idx", "gated", "acted"]]

        return step

    heard = signals.where(F.col("detector").isin(*known))
    flags = ordered_fold(
        heard.select(*CELL, "detector", "idx", "turn", "signal"), CELL, ["idx", "turn"], start,
        "stream string, seed int, model string, detector string, idx long, gated string, acted boolean")
    return heard.join(flags, [*CELL, "detector", "idx"])


def rebuild_starts(acted: DataFrame, min_rebuild: int, buffer_rows: int) -> DataFrame:
    """(cell, idx, detector, train_from, rebuild_size) of every rebuild.

    The error channel rebuilds from its own window, at least min_rebuild rows and at most the
    buffer; the vocabulary channel from its warning buffer.
    """
    size = F.least(F.greatest(F.col("width"), F.lit(min_rebuild)), F.lit(buffer_rows))
    first = F.when(F.col("detector") == "adwin", F.greatest(F.col("idx") - size + 1, F.lit(0))).otherwise(
        F.col("train_from"))
    return acted.where("acted").select(
        *CELL, "idx", "detector", first.alias("train_from"), (F.col("idx") - first + 1).alias("rebuild_size"))


def fast_set(strategy_trace: DataFrame, acted: DataFrame, lam_max: float, period: int, extent: DataFrame) -> DataFrame:
    """Rate per row range with the fast-set reaction laid over the strategy's own trace.

    Each acted error rise sets the rate to lam_max for `period` rows; the strategy's changes in
    between are remembered and take over afterwards. Returns (cell, from_idx, to_idx, lam),
    rows from_idx < idx <= to_idx.
    """
    raised = acted.where("detector = 'adwin' and acted")
    none, zero = F.lit(None).cast("double"), F.lit(0)
    marks = (
        strategy_trace.select(*CELL, "idx", F.col("lam").cast("double").alias("lam"), zero.alias("step"))
        .unionByName(raised.select(*CELL, "idx", none.alias("lam"), F.lit(1).alias("step")))
        .unionByName(raised.select(*CELL, (F.col("idx") + period).alias("idx"), none.alias("lam"), F.lit(-1).alias("step")))
        .groupBy(*CELL, "idx").agg(F.max("lam").alias("lam"), F.sum("step").alias("step"))
    )
    order = Window.partitionBy(*CELL).orderBy("idx")
    own = F.last("lam", ignorenulls=True).over(order)
    active = F.sum("step").over(order) > 0
    following = F.lead("idx").over(order)
    return (
        marks.join(extent.select("stream", "seed", "n"), ["stream", "seed"])
        .select(*CELL, F.col("idx").alias("from_idx"),
                F.least(F.coalesce(following, F.col("n")), F.col("n")).alias("to_idx"),
                F.when(active, F.lit(lam_max)).otherwise(own).alias("lam"), "n")
        .where("from_idx < n").drop("n")
    )
