"""Metric-store queries, over metric points derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.base import query
from driftloom.plans import metricstore
from driftloom.plans.streams import table
from driftloom.sources.sinks import long_form

FIELDS = ["accuracy", "latency_ms"]
# One point per event: run by user, model by event type, two fields.
POINTS = """WITH points AS (
  SELECT 'run-' || CAST(user_id % 6 AS VARCHAR) AS run, event_type AS model, ts AS time, field, value FROM (
    SELECT user_id, event_type, ts, 'accuracy' AS field, value / 500 AS value FROM events
    UNION ALL SELECT user_id, event_type, ts, 'latency_ms', value * 3 FROM events))
"""


def wide(spark, d):
    return table(spark, d, "events").select(
        F.lit("events").alias("stream"), F.concat(F.lit("run-"), (F.col("user_id") % 6).cast("string")).alias("run"),
        F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("time"),
        (F.col("value") / 500).alias("accuracy"), (F.col("value") * 3).alias("latency_ms"), "event_id")


def points(spark, d):
    return long_form(wide(spark, d), ["stream", "run", "model"], FIELDS)


def micros(df):
    return df.withColumn("time_us", F.unix_micros("time")).drop("time")


@query("flx_filter", POINTS + """
SELECT run, model, field, value, epoch_us(time) AS time_us FROM points
WHERE run = 'run-1' AND field = 'accuracy' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-20'""")
def _(spark, d):
    start, stop = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return micros(metricstore.select_points(points(spark, d), "run-1", ["accuracy"], start, stop).drop("stream"))


@query("flx_series", POINTS + "SELECT run, model, epoch_us(time) AS time_us, value FROM points WHERE field = 'accuracy'")
def _(spark, d):
    return micros(metricstore.series_by_model(points(spark, d), "accuracy"))


@query("flx_moving_average", POINTS + """
SELECT run, model, epoch_us(time) AS time_us, round(value, 6) AS value FROM (
  SELECT run, model, time, avg(value) OVER p AS value, row_number() OVER o AS pos, count(*) OVER (PARTITION BY run, model) AS size
  FROM points WHERE field = 'accuracy'
  WINDOW p AS (PARTITION BY run, model ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), o AS (PARTITION BY run, model ORDER BY time))
WHERE pos >= 5 OR (size < 5 AND pos = size)""")
def _(spark, d):
    series = metricstore.series_by_model(points(spark, d), "accuracy")
    return micros(metricstore.moving_average(series, ["run", "model"]).withColumn("value", F.round("value", 6)))


@query("flx_pivot", POINTS + """
SELECT run, model, epoch_us(time) AS time_us, max(value) FILTER (field = 'accuracy') AS accuracy,
  max(value) FILTER (field = 'latency_ms') AS latency_ms FROM points GROUP BY run, model, time""")
def _(spark, d):
    return micros(metricstore.pivot_fields(points(spark, d), ["run", "model", "time"], FIELDS))


@query("flx_runs", POINTS + "SELECT DISTINCT run FROM points ORDER BY run DESC")
def _(spark, d):
    return metricstore.runs_newest_first(points(spark, d))


@query("flx_annotations", """
SELECT epoch_us(ts) AS time_us, event_type || ': adwin change' AS text FROM events WHERE user_id % 6 = 2 AND event_type = 'click' AND value > 50""")
def _(spark, d):
    events = table(spark, d, "events").select(
        F.concat(F.lit("run-"), (F.col("user_id") % 6).cast("string")).alias("run"), F.lit("adwin").alias("detector"),
        F.col("event_type").alias("model"), F.when(F.col("value") > 50, "change").otherwise("warning").alias("kind"),
        F.col("ts").cast("timestamp").alias("time"), F.concat("event_type", F.lit(": adwin change")).alias("text"))
    return micros(metricstore.annotations(events, "run-2", "adwin", "click"))


@query("flx_run_span", POINTS + """
SELECT run, (CAST(floor(epoch_us(min(time)) / 1000000) AS BIGINT) - 20) * 1000 AS from_ms,
  (CAST(floor(epoch_us(max(time)) / 1000000) AS BIGINT) + 20) * 1000 AS to_ms FROM points GROUP BY run""")
def _(spark, d):
    return metricstore.run_span(points(spark, d))


@query("flx_newest_runs", POINTS + """
SELECT run, count(*) AS n FROM points WHERE run IN (SELECT run FROM points GROUP BY run ORDER BY min(time) DESC, run DESC LIMIT 3) GROUP BY run""")
def _(spark, d):
    return metricstore.newest_runs(points(spark, d)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


# Micro-batches: one per run and hour.
PIPELINE = """WITH pipeline AS (
  SELECT 'run-' || CAST(user_id % 6 AS VARCHAR) AS run, date_trunc('hour', ts) AS time, count(*) AS n, avg(value) AS latency_ms,
    max(value) AS latency_p95_ms, sum(value) AS batch_ms FROM events GROUP BY ALL),
models AS (
  SELECT 'run-' || CAST(user_id % 6 AS VARCHAR) AS run, event_type AS model, date_trunc('hour', ts) AS time, sum(value) AS processing_ms,
    max(value) / 500 AS accuracy_cum FROM events GROUP BY ALL)
"""


def pipeline(spark, d):
    return wide(spark, d).withColumn("value", F.col("accuracy") * 500).groupBy("run", F.date_trunc("hour", "time").alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("latency_ms"), F.max("value").alias("latency_p95_ms"), F.sum("value").alias("batch_ms"))


def models(spark, d):
    return wide(spark, d).withColumn("value", F.col("accuracy") * 500).groupBy("run", "model", F.date_trunc("hour", "time").alias("time")).agg(
        F.sum("value").alias("processing_ms"), (F.max("value") / 500).alias("accuracy_cum"))


@query("flx_bench_pipeline", PIPELINE + """
SELECT run, CAST(sum(n) AS BIGINT) AS n, count(*) AS batches, round(avg(n), 4) AS mean_batch_size,
  round(sum(n) / nullif((epoch_us(max(time)) - epoch_us(min(time))) / CAST(1e6 AS DOUBLE), 0), 6) AS achieved_throughput,
  round(median(latency_ms), 4) AS latency_median_ms, round(quantile_cont(latency_p95_ms, CAST(0.95 AS DOUBLE)), 4) AS latency_p95_ms,
  round(max(latency_p95_ms), 4) AS latency_max_ms, round(median(batch_ms), 4) AS batch_ms_p50,
  round(quantile_cont(batch_ms, CAST(0.95 AS DOUBLE)), 4) AS batch_ms_p95 FROM pipeline GROUP BY run""")
def _(spark, d):
    out = metricstore.bench_pipeline(pipeline(spark, d))
    return out.select("run", "n", "batches", F.round("achieved_throughput", 6).alias("achieved_throughput"), *[
        F.round(c, 4).alias(c) for c in out.columns if c not in ("run", "n", "batches", "achieved_throughput")])


@query("flx_bench_models", PIPELINE + """
SELECT m.run, m.model, round(1000 * sum(processing_ms) / CAST(sum(n) AS DOUBLE), 4) AS ms_per_1k, round(arg_max(accuracy_cum, m.time), 6) AS accuracy
FROM models m JOIN pipeline p ON p.run = m.run AND p.time = m.time GROUP BY ALL""")
def _(spark, d):
    out = metricstore.bench_models(models(spark, d), pipeline(spark, d))
    return out.select("run", "model", F.round("ms_per_1k", 4).alias("ms_per_1k"), F.round("accuracy", 6).alias("accuracy"))
