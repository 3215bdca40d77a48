"""Sinks: streams with sidecars, results, and the time-series tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

MEASUREMENTS = ("model_metrics", "pipeline_metrics", "drift_event")


def stream_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per stream: n, positive share (4 digits) and whether idx is exactly 0..n-1."""
    n = F.count(F.lit(1))
    dense = (F.min("idx") == 0) & (F.max("idx") == n - 1) & (F.count_distinct("idx") == n)
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.round(F.avg("label"), 4).alias("positive_share"), dense.alias("dense"))


def save_streams(rows: DataFrame, sidecars: DataFrame, root: str) -> None:
    """Write streams partitioned by (stream, seed) and one metadata row per stream, next to those that are there.

    `sidecars` holds drift metadata per (stream, seed). Refuses an index with holes. Only the streams in `rows` are
    replaced; files are sorted by idx, so that the bounds of a slice skip row groups.
    """
    meta = stream_metadata(rows, ["stream", "seed"])
    if meta.where("not dense").limit(1).count():
        raise ValueError("idx must be 0..n-1 in every stream")
    key = ["stream", "seed"]
    sorted_rows = rows.repartitionByRange(*key, "idx").sortWithinPartitions(*key, "idx")
    replace_parts(sorted_rows, key).parquet(os.path.join(root, "streams"))
    replace_parts(meta.drop("dense").join(sidecars, key), key).json(os.path.join(root, "drift_points"))


def replace_parts(df: DataFrame, keys: list[str]) -> DataFrameWriter:
    """Writer that replaces the partitions in `df` and no others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def result_path(root: str, name: str, partial: bool = False) -> str:
    """A filtered run is written next to the full result, never over it."""
    return os.path.join(root, f"{name}_partial" if partial else name)


def save_results(tables: dict[str, DataFrame], root: str, partial: bool = False) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(result_path(root, name, partial))


def append_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new run rows together; columns missing on one side are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def save_run_detail(events: DataFrame, trace: DataFrame, checks: DataFrame, root: str) -> None:
    """Events, rate trace and checks of each run as JSON."""
    for name, df in (("events", events), ("lambda_trace", trace), ("checks", checks)):
        replace_parts(df, ["run"]).json(os.path.join(root, name))


def drift_event_points(events: DataFrame) -> DataFrame:
    """Annotation points of changes and rebuilds; warnings are left out."""
    label = F.concat(
        F.col("model"), F.lit(": "), F.col("detector"), F.lit(" "), F.col("kind"), F.lit(" at "),
        F.format_number("idx", 0))
    return events.where("kind <> 'warning'").withColumn("text", label)


def long_form(points: DataFrame, tags: list[str], fields: list[str]) -> DataFrame:
    """(tags, time, field, value): numbers as double, missing fields dropped."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return points.select(*tags, "time", F.inline(pairs)).where(F.col("value").isNotNull())


def write_points(points: DataFrame, root: str, measurement: str, batch_id: int) -> None:
    """Append one micro-batch of points; a replayed batch replaces its own files only."""
    if measurement not in MEASUREMENTS:
        raise ValueError(f"measurement {measurement!r} is not one of {MEASUREMENTS}")
    path = os.path.join(root, measurement, f"batch_id={batch_id}")
    points.write.mode("overwrite").parquet(path)
