"""Evaluation of predictions and detections.

    predictions  stream, seed, model, idx, label, pred
    events       stream, seed, model, idx, detector, kind, acted
    drifts       stream, seed, p, e          (a sudden drift has e = p)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.prefix import BLOCK_ROWS, block_of, blocks_between, running
from driftloom.operators.ranks import with_quantiles
from driftloom.session import cut

STREAM = ["stream", "seed"]
CELL = ["stream", "seed", "model"]
DETECTORS = ("model", "vocab", "adwin")
RECOVERY_RATIO = 0.95
PRE_WINDOWS = 5


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_summary(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, precision / recall / F1 per class and macro means; 0 where undefined."""
    y, p = F.col("label"), F.col("pred")
    counts = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("_right"),
        *[F.count_if((y == c) & (p == c)).alias(f"_tp{c}") for c in (0, 1)],
        *[F.count_if(p == c).alias(f"_pred{c}") for c in (0, 1)],
        *[F.count_if(y == c).alias(f"_true{c}") for c in (0, 1)],
    )
    out = counts.withColumn("accuracy", F.col("_right") / F.col("n"))
    for c in (0, 1):
        out = out.withColumn(f"precision_{c}", _ratio(F.col(f"_tp{c}"), F.col(f"_pred{c}")))
        out = out.withColumn(f"recall_{c}", _ratio(F.col(f"_tp{c}"), F.col(f"_true{c}")))
        pr, re = F.col(f"precision_{c}"), F.col(f"recall_{c}")
        out = out.withColumn(f"f1_{c}", _ratio(2 * pr * re, pr + re))
    for m in ("precision", "recall", "f1"):
        out = out.withColumn(f"{m}_macro", (F.col(f"{m}_0") + F.col(f"{m}_1")) / 2)
    return out.select(
        *keys, "n", "accuracy",
        *[f"{m}_{c}" for c in (0, 1) for m in ("precision", "recall", "f1")],
        *[f"{m}_macro" for m in ("precision", "recall", "f1")])


def windowed_accuracy(predictions: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Accuracy per tumbling row-count window; the last partial window is kept."""
    return (
        predictions.groupBy(*keys, F.floor(F.col("idx") / window).cast("long").alias("win"))
        .agg((F.max("idx") + 1).alias("end_idx"),
             F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))
    )


def windowed_share(rows: DataFrame, keys: list[str], window: int, **shares: Column) -> DataFrame:
    """Mean of each value per complete row-count window, at the window's middle."""
    return (
        rows.groupBy(*keys, F.floor(F.col("idx") / window).cast("long").alias("win"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(n) for n, c in shares.items()])
        .where(F.col("_n") == window)
        .select(*keys, "win", ((F.col("win") + 0.5) * window).alias("mid"), *shares)
    )


def split_summary(predictions: DataFrame, main_points: DataFrame, keys: list[str]) -> DataFrame:
    """Classification summary before and after each stream's main drift."""
    sided = predictions.join(main_points, STREAM).withColumn(
        "side", F.when(F.col("idx") < F.col("main"), "pre").otherwise("post"))
    return classification_summary(sided, [*keys, "side"])


def main_points(drifts: DataFrame) -> DataFrame:
    """Natural change point of a stream where one is given, else its last drift."""
    natural = F.max("natural") if "natural" in drifts.columns else F.lit(None).cast("long")
    return drifts.groupBy(*STREAM).agg(F.coalesce(natural, F.max("p")).alias("main"))


def detections(events: DataFrame) -> DataFrame:
    """Three views of an event log: what the model acted on, and each detector's changes."""
    views = F.array_compact(F.array(
        F.when(F.coalesce("acted", F.lit(False)), F.lit("model")),
        F.when(F.col("kind") == "change", F.col("detector")),
    ))
    return events.select(*CELL, "idx", F.explode(views).alias("view"))


def detection_delays(found: DataFrame, drifts: DataFrame, tolerance: Column, cells: DataFrame) -> DataFrame:
    """Per (cell, view, drift): rows from the drift to the first detection in [p, e + T).

    One ordered pass over drifts and detections: the first detection at or after p counts if
    it comes before the end.
    """
    views = F.explode(F.array(*[F.lit(v) for v in DETECTORS]))
    wanted = cells.join(drifts, STREAM).withColumn("view", views).select(
        *CELL, "view", F.col("p").alias("_at"), F.lit(0).alias("_turn"), "e", (F.col("e") + tolerance).alias("_end"))
    hits = found.select(*CELL, "view", F.col("idx").alias("_at"), F.lit(1).alias("_turn"))
    after = Window.partitionBy(*CELL, "view").orderBy("_at", "_turn").rowsBetween(1, Window.unboundedFollowing)
    first = F.min(F.when(F.col("_turn") == 1, F.col("_at"))).over(after)
    return (
        wanted.unionByName(hits, allowMissingColumns=True).withColumn("_first", first).where("_turn = 0")
        .select(*CELL, "view", F.col("_at").alias("p"), "e",
                F.when(F.col("_first") < F.col("_end"), F.col("_first") - F.col("_at")).alias("delay"))
    )


def false_alarms(found: DataFrame, drifts: DataFrame, tolerance: Column) -> DataFrame:
    """Detections inside no acceptance interval.

    A detection is inside one exactly if the latest end among the drifts at or before it is
    still ahead, which a running maximum tells.
    """
    spans = drifts.select(
        *STREAM, F.col("p").alias("_at"), F.lit(0).alias("_turn"), (F.col("e") + tolerance).alias("_end"))
    marks = found.withColumn("_at", F.col("idx")).withColumn("_turn", F.lit(1))
    upto = Window.partitionBy(*STREAM).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(spans, allowMissingColumns=True).withColumn("_open", F.max("_end").over(upto))
        .where((F.col("_turn") == 1) & ~F.coalesce(F.col("_open") > F.col("idx"), F.lit(False)))
        .select(*found.columns)
    )


def detection_metrics(events: DataFrame, drifts: DataFrame, tolerance: Column, cells: DataFrame) -> DataFrame:
    """Per (cell, view): detections, detected, missed, false alarms and mean delay."""
    found = detections(events)
    delays = detection_delays(found, drifts, tolerance, cells).groupBy(*CELL, "view").agg(
        F.count("delay").alias("detected"), F.count_if(F.col("delay").isNull()).alias("missed"),
        F.avg("delay").alias("mean_delay"))
    total = found.groupBy(*CELL, "view").agg(F.count(F.lit(1)).alias("detections"))
    wrong = false_alarms(found, drifts, tolerance).groupBy(*CELL, "view").agg(
        F.count(F.lit(1)).alias("false_alarms"))
    key = [*CELL, "view"]
    return delays.join(total, key, "left").join(wrong, key, "left").fillna(
        0, ["detections", "false_alarms"]).select(
        *key, "detections", "detected", "missed", "false_alarms", "mean_delay")


def recovery_times(
    predictions: DataFrame, drifts: DataFrame, window: int,
    block_rows: int = BLOCK_ROWS, ratio: float = RECOVERY_RATIO,
) -> DataFrame:
    """Per (cell, drift): rows until a full window is back at `ratio` of the level before.

    The level before is the accuracy of up to five windows before the drift, not reaching past
    the previous drift; NULL when that is shorter than one window or accuracy never comes back
    before the next drift. 0 means it never fell.
    """
    rows = predictions.select(
        *CELL, "idx", (F.col("label") == F.col("pred")).cast("long").alias("right"),
        block_of(F.col("idx"), block_rows).alias("blk"))
    level = cut(running(rows, CELL, "idx", "blk", sums={"before": F.col("right")}), "correct-sums")
    extent = level.groupBy(*CELL).agg((F.max("idx") + 1).alias("n"))

    order = Window.partitionBy(*STREAM).orderBy("p")
    marks = drifts.select(
        *STREAM, "p", F.coalesce(F.lag("p").over(order), F.lit(0)).alias("prev"),
        F.lead("p").over(order).alias("next"))
    marks = extent.join(marks, STREAM).withColumn("w", F.lit(window).cast("long")).select(
        *CELL, "p", "w", "n", F.coalesce("next", "n").alias("bound"),
        F.greatest(F.col("prev"), F.col("p") - PRE_WINDOWS * F.col("w")).alias("from"))

    def sums_at(name: str) -> DataFrame:
        return level.select(*CELL, F.col("idx").alias(name), F.col("before").alias(f"_at_{name}"))

    usable = marks.where((F.col("p") - F.col("from") >= F.col("w")) & (F.col("p") < F.col("n")))
    targets = usable.join(sums_at("p"), [*CELL, "p"]).join(sums_at("from"), [*CELL, "from"]).withColumn(
        "target", ratio * (F.col("_at_p") - F.col("_at_from")) / (F.col("p") - F.col("from")))

    # Windows that start in [p, bound - w]: the row s and the row s + w - 1, by equality.
    searched = targets.withColumn("to", F.col("bound") - F.col("w")).where("to >= p")
    spans = blocks_between(searched.select(*CELL, "p", "w", "to", "target"), "p", "to", block_rows)
    starts = level.join(spans, [*CELL, "blk"]).where("idx between p and to").select(
        *CELL, "p", "w", "target", "idx", "before", (F.col("idx") + F.col("w") - 1).alias("end"))
    ends = level.select(*CELL, F.col("idx").alias("end"), (F.col("before") + F.col("right")).alias("upto"))
    reached = (
        starts.join(ends, [*CELL, "end"])
        .where((F.col("upto") - F.col("before")) / F.col("w") >= F.col("target"))
        .groupBy(*CELL, "p").agg((F.min("idx") - F.col("p")).alias("recovery"))
    )
    return marks.select(*CELL, "p").join(reached, [*CELL, "p"], "left")


def recovery_rollup(recovery: DataFrame) -> DataFrame:
    """Mean and maximum recovery, drifts never recovered from, and the list in drift order."""
    listed = F.array_sort(F.collect_list(F.struct("p", "recovery")))
    return recovery.groupBy(*CELL).agg(
        F.avg("recovery").alias("recovery_mean"), F.max("recovery").alias("recovery_max"),
        F.count_if(F.col("recovery").isNull()).alias("not_recovered"),
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda d: F.coalesce(
            d["recovery"].cast("string"), F.lit("null"))), ", "), F.lit("]")).alias("recovery_per_drift"))


def metrics_row(
    predictions: DataFrame, events: DataFrame, drifts: DataFrame, tolerance: int, recovery_window: int,
    sizes: DataFrame | None = None, block_rows: int = BLOCK_ROWS, blind: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (stream, seed, model) with quality, detection and recovery.

    `predictions` is a table. `sizes` may give model_entries per cell. Tolerance and recovery window are settings of the
    run, never guessed from the number of rows. Models named in `blind` have no detector: their detection columns and
    rebuilds are NULL.
    """
    summary = classification_summary(predictions, CELL)
    points = drifts.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n_drifts"))
    main = main_points(drifts)
    sides = split_summary(predictions, main, CELL).groupBy(*CELL).agg(
        F.max(F.when(F.col("side") == "pre", F.col("accuracy"))).alias("accuracy_pre_drift"),
        F.max(F.when(F.col("side") == "post", F.col("accuracy"))).alias("accuracy_post_drift"))
    cells = summary.select(*CELL, "n", F.lit(tolerance).cast("long").alias("tolerance"), F.lit(recovery_window).cast("long").alias("recovery_window"))
    cells = cut(cells, "cells")
    per_stream = cells.select(*STREAM, "tolerance").distinct()
    timed = drifts.select(*STREAM, "p", "e").join(per_stream, STREAM)
    found = detection_metrics(events, timed, F.col("tolerance"), cells.select(*CELL))
    fields = ("detections", "detected", "missed", "false_alarms", "mean_delay")
    blocks = found.groupBy(*CELL).agg(*[
        F.max(F.when(F.col("view") == v, F.col(f))).alias(f"{v}_{f}") for v in DETECTORS for f in fields])
    rebuilt = events.where("kind = 'rebuild'").groupBy(*CELL).agg(F.count(F.lit(1)).alias("rebuilds"))
    recovered = recovery_rollup(recovery_times(predictions, drifts, recovery_window, block_rows))
    out = (
        cells.join(summary.drop("n"), CELL).join(points, STREAM).join(main.withColumnRenamed("main", "drift_point"), STREAM)
        .join(sides, CELL, "left").join(blocks, CELL, "left").join(rebuilt, CELL, "left")
        .join(recovered, CELL, "left").fillna(0, ["rebuilds"])
    )
    if blind:
        seen = ~F.col("model").isin(*blind)
        for c in (*[f"{v}_{f}" for v in DETECTORS for f in fields], "rebuilds"):
            out = out.withColumn(c, F.when(seen, F.col(c)))
    columns = [
        *CELL, "n", "n_drifts", "drift_point", "accuracy", "precision_macro", "recall_macro", "f1_macro",
        "accuracy_pre_drift", "accuracy_post_drift",
        *[f"{v}_{f}" for v in DETECTORS for f in fields], "rebuilds",
        "recovery_mean", "recovery_max", "not_recovered", "recovery_per_drift",
        "tolerance", "recovery_window"]
    if sizes is not None:
        out, columns = out.join(sizes, CELL, "left"), [*columns, "model_entries"]
    return out.select(*columns)


def batch_metrics(batches: DataFrame) -> DataFrame:
    """Per-batch and cumulative accuracy of each (run, model) over its batches."""
    order = Window.partitionBy("run", "model").orderBy("batch")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return batches.select(
        "run", "model", "batch", "n", (F.col("right") / F.col("n")).alias("accuracy"),
        (F.sum("right").over(upto) / F.sum("n").over(upto)).alias("accuracy_cum"),
        F.sum("n").over(upto).alias("seen"))


def cost_summary(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Processing cost: milliseconds per 1,000 rows, median and p95 batch time, rows per second."""
    summary = batches.groupBy(*keys).agg(
        (1000 * F.sum("ms") / F.sum("n")).alias("ms_per_1k"), (1000 * F.sum("n") / F.sum("ms")).alias("throughput"))
    return with_quantiles(summary, batches, keys, {"batch_ms_p50": ("ms", 0.5), "batch_ms_p95": ("ms", 0.95)}).select(
        *keys, "ms_per_1k", "batch_ms_p50", "batch_ms_p95", "throughput")
