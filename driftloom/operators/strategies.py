"""Reactions to detector signals: the ageing rate after each check, and rebuilds.

    checks  stream, seed, model, win, idx, signal
    specs   stream, seed, model, strategy, lam, lam_max, c, decrease
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.fold import ordered_fold
from driftloom.operators.vocabulary import CHANGE

CELL = ["stream", "seed", "model"]
# The names of the strategies.
STRATEGIES = (
    "SlowIncreaseUpToALimit", "SlowIncreaseFastReset", "FastSetFastReset",
    "FastSetSlowDecrease", "Rebuild",
)
# Rates are rounded to this many digits, so equal rates compare equal.
RATE_DIGITS = 12


def known_strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"strategy {name!r} is not one of {STRATEGIES}")
    return name


def rates(checks: DataFrame, specs: DataFrame) -> DataFrame:
    """Add lam0 and `lam`, the strategy's rate after each check.

    Four strategies have a closed form over the signals; only the increase with reset, where a
    reset swallows a signal, is a fold.
    """
    rows = checks.join(
        specs.select(*CELL, "strategy", F.col("lam").alias("lam0"), "lam_max", "c", "decrease"), CELL)
    folded = _increase_with_reset(rows.where("strategy = 'SlowIncreaseFastReset'"))
    plain = rows.where("strategy <> 'SlowIncreaseFastReset'")

    order = Window.partitionBy(*CELL).orderBy("win")
    change = F.col("signal") == CHANGE
    changes = F.count_if(change).over(order)
    quiet = F.count_if(~change).over(Window.partitionBy(*CELL, "_changes").orderBy("win"))
    staged = plain.withColumn("_changes", changes).withColumn("_quiet", quiet)

    lam0, top = F.col("lam0"), F.col("lam_max")
    stepped = F.least(lam0 + F.col("c") * F.col("_changes"), top)
    shrunk = top * F.pow(1 - F.col("decrease"), F.col("_quiet"))
    decayed = F.when(F.col("_changes") == 0, lam0).when(
        (F.col("_quiet") == 0) | (shrunk > lam0 + 1e-9), shrunk).otherwise(lam0)
    lam = (
        F.when(F.col("strategy") == "SlowIncreaseUpToALimit",
               F.when(F.col("_changes") == 0, lam0).otherwise(stepped))
        .when(F.col("strategy") == "FastSetFastReset", F.when(change, top).otherwise(lam0))
        .when(F.col("strategy") == "FastSetSlowDecrease", decayed)
        .otherwise(lam0)
    )
    columns = [*checks.columns, "strategy", "lam0"]
    return (
        staged.withColumn("lam", F.round(lam, RATE_DIGITS)).select(*columns, "lam")
        .unionByName(folded.select(*columns, "lam"))
    )


def _increase_with_reset(rows: DataFrame) -> DataFrame:
    keyed = rows.select(*CELL, "win", "signal", "lam0", "lam_max", "c")
    after = ordered_fold(
        keyed, CELL, ["win"], _reset_step,
        "stream string, seed int, model string, win long, lam double")
    return rows.join(after, [*CELL, "win"])


def _reset_step():
    held: list[float] = []

    def after(row) -> float:
        lam = held[0] if held else row.lam0
        if lam >= row.lam_max:
            lam = row.lam0
        elif row.signal == CHANGE:
            lam = min(round(lam + row.c, RATE_DIGITS), row.lam_max)
        held[:] = [lam]
        return lam

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(lam=[after(row) for row in batch.itertuples()])
        return batch[["stream", "seed", "model", "win", "lam"]]

    return step


def rate_changes(rated: DataFrame) -> DataFrame:
    """(stream, seed, model, idx, lam): checks after which the rate differs from before."""
    order = Window.partitionBy(*CELL).orderBy("win")
    before = F.coalesce(F.lag("lam").over(order), F.round("lam0", RATE_DIGITS))
    return rated.withColumn("_before", before).where("lam <> _before").select(*CELL, "idx", "lam")


def rate_trace(rated: DataFrame, specs: DataFrame) -> DataFrame:
    """The start rate at row 0 and every change of the rate."""
    start = specs.select(
        *CELL, F.lit(0).cast("long").alias("idx"), F.round("lam", RATE_DIGITS).alias("lam"))
    return start.unionByName(rate_changes(rated))


def rebuilds(rated: DataFrame) -> DataFrame:
    """Checks at which the Rebuild strategy replaces the model."""
    return rated.where((F.col("strategy") == "Rebuild") & (F.col("signal") == CHANGE))


def vocabulary_events(rated: DataFrame) -> DataFrame:
    """Event log of the vocabulary channel: warnings, changes and rebuilds."""
    raised = rated.where("signal <> 'none'").select(
        *CELL, "idx", F.lit("vocab").alias("detector"), F.col("signal").alias("kind"),
        (F.col("signal") == CHANGE).alias("acted"), F.lit(None).cast("long").alias("rebuild_size"))
    rebuilt = rebuilds(rated).select(
        *CELL, "idx", F.lit("vocab").alias("detector"), F.lit("rebuild").alias("kind"),
        F.lit(None).cast("boolean").alias("acted"),
        (F.col("idx") - F.col("train_from") + 1).alias("rebuild_size"))
    return raised.unionByName(rebuilt)


def segments(rated: DataFrame, specs: DataFrame, extent: DataFrame) -> DataFrame:
    """Model segments: a new one after every rate change and every rebuild.

    `extent` holds n per (stream, seed). A reaction at row r works from row r + 1 on; a
    rebuilt model has learned rows train_from..r and starts again at the initial rate.
    """
    alpha = specs.select(*CELL, F.col("alpha").cast("double"), F.col("lam").cast("double").alias("lam0"))
    start = alpha.select(
        *CELL, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("b"),
        F.round("lam0", RATE_DIGITS).alias("lam"))
    moved = rate_changes(rated).select(
        *CELL, (F.col("idx") + 1).alias("lo"), F.lit(0).cast("long").alias("b"), "lam")
    rebuilt = rebuilds(rated).select(
        *CELL, (F.col("idx") + 1).alias("lo"), F.col("train_from").alias("b"),
        F.round("lam0", RATE_DIGITS).alias("lam"))
    order = Window.partitionBy(*CELL).orderBy("lo")
    return (
        start.unionByName(moved).unionByName(rebuilt)
        .join(extent.select("stream", "seed", "n"), ["stream", "seed"]).where("lo < n")
        .withColumn("hi", F.coalesce(F.lead("lo").over(order), F.col("n")) - 1)
        .join(alpha.drop("lam0"), CELL)
        .select(*CELL, "b", "lam", "alpha", "lo", "hi")
    )
