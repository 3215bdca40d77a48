"""Queries over the time-series tables written by the live stream.

    model_metrics     stream, run, model, time, accuracy, accuracy_cum, f1_macro, lambda, ...
    pipeline_metrics  stream, run, time, n, throughput, latency_ms, latency_p95_ms, batch_ms, ...
    drift_event       stream, run, model, detector, kind, time, idx, text
    long form         tags, time, field, value
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.ranks import with_quantiles


def select_points(points: DataFrame, run: str, fields: list[str], start=None, stop=None) -> DataFrame:
    """Points of one run, some fields and a time range [start, stop)."""
    rows = points.where((F.col("run") == run) & F.col("field").isin(*fields))
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if stop is not None:
        rows = rows.where(F.col("time") < stop)
    return rows


def series_by_model(points: DataFrame, field: str) -> DataFrame:
    """One series per model, in time order."""
    return points.where(F.col("field") == field).select("run", "model", "time", "value").orderBy(
        "run", "model", "time")


def moving_average(series: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Mean of the last n points; a series gives no value before its n-th point, and a series
    of fewer than n points gives its overall mean once, at its last point."""
    order = Window.partitionBy(*keys).orderBy("time")
    staged = series.select(
        *keys, "time", F.avg("value").over(order.rowsBetween(-(n - 1), 0)).alias("value"),
        F.row_number().over(order).alias("_at"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_size"))
    return staged.where((F.col("_at") >= n) | ((F.col("_size") < n) & (F.col("_at") == F.col("_size")))).drop(
        "_at", "_size")


def pivot_fields(points: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key with a column per field."""
    return points.groupBy(*keys).pivot("field", fields).agg(F.first("value"))


def runs_newest_first(points: DataFrame) -> DataFrame:
    return points.select("run").distinct().orderBy(F.desc("run"))


def annotations(events: DataFrame, run: str, detector: str, model: str) -> DataFrame:
    return events.where(
        (F.col("run") == run) & (F.col("detector") == detector) & (F.col("model") == model)
        & (F.col("kind") == "change")).select("time", "text")


def run_span(points: DataFrame, pad_seconds: int = 20) -> DataFrame:
    """First and last time of each run in epoch milliseconds, padded."""
    return points.groupBy("run").agg(
        ((F.unix_seconds(F.min("time")) - pad_seconds) * 1000).alias("from_ms"),
        ((F.unix_seconds(F.max("time")) + pad_seconds) * 1000).alias("to_ms"))


def newest_runs(points: DataFrame, keep: int = 3) -> DataFrame:
    """Points of the `keep` runs that started last."""
    starts = points.groupBy("stream", "run").agg(F.min("time").alias("_start"))
    order = Window.partitionBy("stream").orderBy(F.desc("_start"), F.desc("run"))
    return points.join(
        starts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select("stream", "run"),
        ["stream", "run"])


def bench_pipeline(pipeline: DataFrame) -> DataFrame:
    """Throughput over the run's span, latency and batch-time percentiles."""
    span = (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / F.lit(1e6)
    summary = pipeline.groupBy("run").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("batches"), F.avg("n").alias("mean_batch_size"),
        F.when(span > 0, F.sum("n") / span).alias("achieved_throughput"),
        F.max("latency_p95_ms").alias("latency_max_ms"))
    found = with_quantiles(summary, pipeline, ["run"], {
        "latency_median_ms": ("latency_ms", 0.5), "latency_p95_ms": ("latency_p95_ms", 0.95), "batch_ms_p50": ("batch_ms", 0.5), "batch_ms_p95": ("batch_ms", 0.95)})
    return found.select(
        "run", "n", "batches", "mean_batch_size", "achieved_throughput", "latency_median_ms", "latency_p95_ms", "latency_max_ms", "batch_ms_p50", "batch_ms_p95")


def bench_models(models: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Per model: processing time per 1,000 rows and the last cumulative accuracy."""
    sizes = pipeline.select("run", "time", "n")
    return models.join(sizes, ["run", "time"]).groupBy("run", "model").agg(
        (1000 * F.sum("processing_ms") / F.sum("n")).alias("ms_per_1k"),
        F.max_by("accuracy_cum", "time").alias("accuracy"))
