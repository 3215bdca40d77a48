"""Vocabulary drift detector: how much of a class's known vocabulary the latest window uses.

Windows are counted in rows. Everything up to the precision of a check is an aggregate; only
the signal is sequential, and that runs over one row per check.

    detectors  stream, seed, model, w, reference, detect_alpha, detect_beta, detect_history
    checks     stream, seed, model, win, idx, precision_0, precision_1, signal
"""

from __future__ import annotations

from collections import deque
from math import fsum, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.fold import ordered_fold
from driftloom.session import cut

STREAM = ["stream", "seed"]
NONE, WARNING, CHANGE = "none", "warning", "change"
RANK = {NONE: 0, WARNING: 1, CHANGE: 2}
MIN_HISTORY = 3
# Deviations below this are rounding, not drift.
QUIET = 1e-12


def severity(signal: Column) -> Column:
    return F.when(signal == CHANGE, 2).when(signal == WARNING, 1).otherwise(0)


def window_of(idx: Column, w: Column) -> Column:
    return F.floor(idx / w).cast("long")


def window_words(instances: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (window, class, word) of complete windows, per distinct window size."""
    sizes = windows.select(*STREAM, "w").distinct()
    extent = instances.groupBy(*STREAM).agg((F.max("idx") + 1).alias("n"))
    # Written, so that its size is known: by a join of unknown size all rows of a stream would meet in one task.
    complete = cut(sizes.join(extent, STREAM).withColumn("n_win", F.floor(F.col("n") / F.col("w")).cast("long")), "windows")
    rows = instances.join(complete, STREAM).withColumn("win", window_of(F.col("idx"), F.col("w")))
    words = rows.where("win < n_win").select(
        *STREAM, "w", "win", F.col("label").alias("class"), F.explode("bag.word").alias("word"))
    return words.distinct()


def precisions(instances: DataFrame, detectors: DataFrame, seen: DataFrame) -> DataFrame:
    """Per check and class: share of the reference vocabulary found in the window.

    `seen` is the result of `window_words`, as a table. The reference is the previous window
    or everything before; NULL where the class has no reference words yet.
    """
    key = [*STREAM, "w"]
    size = seen.groupBy(*key, "win", "class").agg(F.count(F.lit(1)).alias("size"))
    first = seen.groupBy(*key, "class", "word").agg(F.min("win").alias("win"))
    fresh = first.groupBy(*key, "win", "class").agg(F.count(F.lit(1)).alias("fresh"))
    # The window is part of the join key, so a word that is in every window is no hot key.
    back = seen.withColumn("win", F.col("win") + 1)
    shared = seen.join(back, [*key, "win", "class", "word"]).groupBy(*key, "win", "class").agg(
        F.count(F.lit(1)).alias("shared"))

    extent = instances.groupBy(*STREAM).agg((F.max("idx") + 1).alias("n"))
    wanted = detectors.select(*key, "reference").distinct().join(extent, STREAM)
    n_win = F.floor(F.col("n") / F.col("w")).cast("long")
    grid = (
        wanted.where(n_win > 0)
        .withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), n_win - 1)))
        .withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
        .drop("n")
    )
    slot = [*key, "win", "class"]
    full = (
        grid.join(size, slot, "left").join(shared, slot, "left").join(fresh, slot, "left")
        .fillna(0, ["size", "shared", "fresh"])
    )
    order = Window.partitionBy(*key, "reference", "class").orderBy("win")
    known = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1))
    previous = F.lag("size").over(order)
    base = F.when(F.col("reference") == "previous", previous).otherwise(known)
    hit = F.when(F.col("reference") == "previous", F.col("shared")).otherwise(
        F.col("size") - F.col("fresh"))
    value = F.when(base > 0, hit / base)
    return (
        full.withColumn("precision", value)
        .groupBy(*key, "reference", "win")
        .agg(F.max(F.when(F.col("class") == 0, F.col("precision"))).alias("precision_0"),
             F.max(F.when(F.col("class") == 1, F.col("precision"))).alias("precision_1"))
        .withColumn("idx", (F.col("win") + 1) * F.col("w") - 1)
    )


def signals(values: DataFrame, detectors: DataFrame) -> DataFrame:
    """Checks with their signal, the stronger one of the two classes."""
    checks = values.join(detectors, [*STREAM, "w", "reference"])
    return ordered_fold(
        checks.select(*STREAM, "model", "w", "win", "idx", "precision_0", "precision_1",
                      "detect_alpha", "detect_beta", "detect_history"),
        [*STREAM, "model"], ["win"], _signal_step,
        "stream string, seed int, model string, w long, win long, idx long, "
        "precision_0 double, precision_1 double, signal string",
    )


def raised(deviation: float, spread: float, thresholds: list[tuple[str, float]]) -> str:
    """First level whose multiple of the spread the deviation is beyond."""
    return next((level for level, times in thresholds if deviation > times * spread), NONE)


class SignalHistory:
    """Past precisions of both classes, with the signal of a new pair: the stronger one of the two classes."""

    def __init__(self, past=((), ())):
        self.past = [deque(values) for values in past]

    def signal(self, values, alpha: float, beta: float, history: int) -> str:
        levels = [self._of_class(c, v, [(CHANGE, alpha), (WARNING, beta)], history)
                  for c, v in enumerate(values) if v is not None and v == v]  # no reference yet: nothing to compare
        return max(levels, key=RANK.get, default=NONE)

    def _of_class(self, c: int, value: float, thresholds: list, history: int) -> str:
        past, n = self.past[c], len(self.past[c])
        level = NONE
        if n >= MIN_HISTORY:
            # exact sums, so that equal values have no spread
            mean = fsum(past) / n
            spread = sqrt(fsum((x - mean) ** 2 for x in past) / n)
            deviation = abs(value - mean)
            level = NONE if deviation <= QUIET else raised(deviation, spread, thresholds)
        kept = [] if level == CHANGE else past
        self.past[c] = deque([*kept, value], maxlen=history)
        return level


def _signal_step():
    history = SignalHistory()

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        found = [
            history.signal((r.precision_0, r.precision_1), r.detect_alpha, r.detect_beta, int(r.detect_history))
            for r in batch.itertuples()
        ]
        return batch.assign(signal=found)[
            ["stream", "seed", "model", "w", "win", "idx", "precision_0", "precision_1", "signal"]]

    return step


def rebuild_from(checks: DataFrame) -> DataFrame:
    """Add `train_from`: the first row of the warning buffer at each warning or change.

    The buffer opens at the first warning window, grows over an unbroken run of warnings, and
    a change closes it; without warnings it is the checked window itself.
    """
    cell = [*STREAM, "model"]
    order = Window.partitionBy(*cell).orderBy("win")
    opens = F.coalesce(F.lag("signal").over(order) != WARNING, F.lit(True))
    runs = checks.withColumn("_run", F.sum(opens.cast("int")).over(order))
    in_run = Window.partitionBy(*cell, "_run").orderBy("win")
    first = F.min(F.col("win") * F.col("w")).over(in_run)
    return runs.withColumn("train_from", F.when(F.col("signal") != NONE, first)).drop("_run")


def detect(instances: DataFrame, detectors: DataFrame, seen: DataFrame) -> DataFrame:
    """All checks of all detectors with precision, signal and rebuild start."""
    return rebuild_from(signals(precisions(instances, detectors, seen), detectors))
