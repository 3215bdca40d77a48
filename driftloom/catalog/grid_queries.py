"""Whole runs on one stream and on a slice of it: the metrics rows of the grid, first of the majority, accumulative, fading and
informed models, then of the enhanced kind, the reports on such rows, and a sweep over settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.catalog.fusion_queries import TWIN_ROUNDS
from driftloom.catalog.model_queries import EVENT_BLOCK, WINDOW_SQL, checks_sql, event_instances, events_window
from driftloom.plans import grid, report, specs, streams, sweep
from driftloom.sources import files

MODELS = {"majority": {"model": "majority"}, "accumulative": {"model": "accumulative"}, "fading": {"model": "fading", "lam": 0.2},
          "baseline": {"model": "informed", "strategy": "Rebuild"}}
TOLERANCE, RECOVERY, ROWS = 1_000, 100, 500

# Segments and predictions of the four models on the flipped events.
CELLS = checks_sql(True).rstrip() + f""",
size AS (SELECT count(*) AS n FROM rows),
starts AS (SELECT 0 AS lo, 0 AS b UNION ALL SELECT idx + 1, train_from FROM checks WHERE signal = 'change'),
segs AS (
  SELECT 'baseline' AS model, b, CAST(0 AS DOUBLE) AS lam, CAST(1 AS DOUBLE) AS alpha, lo, coalesce(lead(lo) OVER (ORDER BY lo), n) - 1 AS hi FROM starts, size WHERE lo < n
  UNION ALL SELECT model, 0, lam, CAST(1 AS DOUBLE), 0, n - 1 FROM (VALUES ('accumulative', CAST(0 AS DOUBLE)), ('fading', CAST(0.2 AS DOUBLE))) AS v(model, lam), size),""" + sql.SCORED + """,
preds AS (
  SELECT model, idx, label, pred, CAST(entries + new_entries AS BIGINT) AS entries FROM scored
  UNION ALL SELECT 'majority', idx, label, CAST(count(*) FILTER (label = 1) OVER p > count(*) FILTER (label = 0) OVER p AS INTEGER), 0 FROM rows
    WINDOW p AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def flipped(spark, d):
    """(instances, drifts) of the events whose labels turn in the middle."""
    inst = event_instances(spark, d, True)
    half = inst.count() // 2
    drifts = spark.createDataFrame([("events", 0, half, half)], "stream string, seed int, p long, e long")
    return inst, drifts


def whole(spark, d):
    inst, drifts = flipped(spark, d)
    table = specs.spec_table(spark, MODELS, {"w": events_window(spark, d)})
    return grid.run(inst, table, drifts, TOLERANCE, RECOVERY, ROWS, EVENT_BLOCK)


@query("grid_rows", CELLS + """
SELECT p.model, count(*) AS n, 1 AS n_drifts, min(n // 2) AS drift_point, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy,
  round(avg(CAST(pred = label AS INTEGER)) FILTER (idx < n // 2), 6) AS accuracy_pre_drift,
  round(avg(CAST(pred = label AS INTEGER)) FILTER (idx >= n // 2), 6) AS accuracy_post_drift,
  CASE WHEN p.model = 'baseline' THEN (SELECT count(*) FROM checks WHERE signal = 'change') END AS vocab_detections,
  CASE WHEN p.model = 'baseline' THEN (SELECT count(*) FROM checks WHERE signal = 'change') END AS rebuilds,
  arg_max(entries, idx) AS model_entries
FROM preds p, size GROUP BY p.model""")
def _(spark, d):
    out = whole(spark, d).metrics
    return out.select("model", "n", "n_drifts", "drift_point", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_pre_drift", "accuracy_post_drift")],
                      "vocab_detections", "rebuilds", "model_entries")


@query("grid_windows", CELLS + f"""
SELECT model, least((idx // {ROWS} + 1) * {ROWS}, min(n)) AS end_idx, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM preds, size GROUP BY model, idx // {ROWS}""")
def _(spark, d):
    return whole(spark, d).windows.select("model", "end_idx", F.round("accuracy", 6).alias("accuracy"))


@query("nb_replay_slice", sql.with_(sql.EVENTS) + f""",
part AS (SELECT *, idx - 100 AS place FROM ev_tokens WHERE idx >= 100 AND idx < (SELECT count(*) // 2 FROM ev)),
rows AS (SELECT place AS idx, epoch_us(ts) / CAST(3.6e9 AS DOUBLE) AS t, label FROM part),
words AS (SELECT idx, word, count(*) AS k FROM (SELECT place AS idx, unnest(tokens) AS word FROM part) GROUP BY ALL),
{sql.whole_segments(("accumulative", 0.0, 1.0), ("fading", 0.2, 1.0)).strip()},{sql.SCORED}
SELECT model, idx + 100 AS idx, label, pred FROM scored""")
def _(spark, d):
    """Models on a slice: they count the rows of the slice, which keep their own numbers in the result."""
    half = streams.table(spark, d, "events").count() // 2
    part = files.replay_slice(streams.events_stream(spark, d), "run-a", 100, half - 100)
    rows = grid.positioned(streams.instances(part, "events"), EVENT_BLOCK)
    table = specs.per_cell(specs.spec_table(spark, {k: MODELS[k] for k in ("accumulative", "fading")}), rows)
    found, _, _ = grid.predictions(rows.drop("at"), table, EVENT_BLOCK)
    return found.join(rows.select("stream", "seed", "idx", "at"), ["stream", "seed", "idx"]).select("model", F.col("at").alias("idx"), "label", "pred")


ADAPTIVE = {"adwin_only": "adwin_only", "either": "or"}


@query("grid_enhanced", checks_sql(True).rstrip() + "," + sql.enhanced(
    ADAPTIVE, WINDOW_SQL, specs.DEFAULTS["cooldown"], specs.DEFAULTS["min_rebuild"], specs.DEFAULTS["buffer_rows"], TWIN_ROUNDS) + """,
size AS (SELECT count(*) AS n FROM rows),
acted AS (SELECT model, count(*) FILTER (kind = 'rebuild') AS rebuilds FROM enhanced_events GROUP BY model)
SELECT e.model, 'enhanced' AS kind, CASE e.model WHEN 'either' THEN 'or' ELSE e.model END AS fusion, CAST(0.01 AS DOUBLE) AS adwin_delta,
  CASE WHEN e.model = 'either' THEN CAST(1.8 AS DOUBLE) END AS detect_alpha, count(*) AS n,
  round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy, round(avg(CAST(pred = label AS INTEGER)) FILTER (idx < n // 2), 6) AS accuracy_pre_drift,
  round(avg(CAST(pred = label AS INTEGER)) FILTER (idx >= n // 2), 6) AS accuracy_post_drift, coalesce(max(a.rebuilds), 0) AS rebuilds
FROM enhanced e LEFT JOIN acted a USING (model), size GROUP BY e.model""")
def _(spark, d):
    """Cells of the enhanced kind in a grid run."""
    inst, drifts = flipped(spark, d)
    table = specs.spec_table(spark, {m: {"model": "enhanced", "fusion": f} for m, f in ADAPTIVE.items()}, {"w": events_window(spark, d)})
    out = grid.run(inst, table, drifts, TOLERANCE, RECOVERY, ROWS, EVENT_BLOCK).metrics
    rates = [F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_pre_drift", "accuracy_post_drift")]
    return out.select("model", "kind", "fusion", "adwin_delta", "detect_alpha", "n", *rates, "rebuilds")


def _swept(alphas) -> str:
    """swept(setting, alpha, idx, label, pred) of informed models over thresholds of the detector."""
    parts = []
    for i, a in enumerate(alphas):
        parts.append(f"""
segs_{i} AS MATERIALIZED (
  WITH RECURSIVE {sql.signals(WINDOW_SQL, alpha=a).strip()}
  SELECT 'baseline a={a}' AS model, b, CAST(0 AS DOUBLE) AS lam, CAST(1 AS DOUBLE) AS alpha, lo, coalesce(lead(lo) OVER (ORDER BY lo), n) - 1 AS hi
  FROM (SELECT 0 AS lo, 0 AS b UNION ALL SELECT idx + 1, train_from FROM checks WHERE signal = 'change'), (SELECT count(*) AS n FROM rows) WHERE lo < n)""")
    union = " UNION ALL ".join(f"SELECT * FROM segs_{i}" for i in range(len(alphas)))
    return ",".join(parts) + f""",
segs AS ({union}),""" + sql.SCORED


SWEEP_SQL = sql.with_(sql.events_rows(True), sql.seen_words(WINDOW_SQL), sql.precisions(WINDOW_SQL), _swept(report.SWEEP_ALPHAS))


def swept(spark, d):
    inst, drifts = flipped(spark, d)
    settings = report.sweep_settings(spark).where("model = 'informed'")
    return sweep.run(inst, settings, drifts, TOLERANCE, RECOVERY, ROWS, {"w": events_window(spark, d)}, EVENT_BLOCK)


@query("sweep_rows", SWEEP_SQL + """
SELECT model AS setting, model, 'informed' AS kind, CAST(NULL AS VARCHAR) AS fusion, CAST(NULL AS DOUBLE) AS adwin_delta, CAST(split_part(model, '=', 2) AS DOUBLE) AS detect_alpha,
  count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy, count(DISTINCT lo) - 1 AS rebuilds
FROM scored GROUP BY model""")
def _(spark, d):
    """Metrics rows of a sweep over the vocabulary detector's thresholds."""
    return swept(spark, d).metrics.select(
        "setting", "model", "kind", "fusion", "adwin_delta", "detect_alpha", "n", F.round("accuracy", 6).alias("accuracy"), "rebuilds")


@query("rpt_sweep_run", SWEEP_SQL + """
SELECT model AS setting, 'informed' AS kind, CAST(NULL AS VARCHAR) AS fusion, CAST(NULL AS DOUBLE) AS adwin_delta, CAST(split_part(model, '=', 2) AS DOUBLE) AS detect_alpha,
  round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy, 1 AS runs
FROM scored GROUP BY model""")
def _(spark, d):
    """The sweep's summary, read from its own metrics rows."""
    return report.sweep_summary(swept(spark, d).metrics).select(
        "setting", *report.SWEEP_FIELDS, F.round("accuracy", 6).alias("accuracy"), "runs")


@query("rpt_grid_run", CELLS + """
SELECT 'events' AS stream, model, 1 AS seeds, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy_mean, CAST(NULL AS DOUBLE) AS throughput_mean,
  CAST(arg_max(entries, idx) AS DOUBLE) AS model_entries_mean FROM preds GROUP BY model""")
def _(spark, d):
    """The grid's summary, read from the metrics rows of a run (cost is not measured here and stays NULL)."""
    out = report.grid_summary(whole(spark, d).metrics, ["accuracy", "throughput", "model_entries"])
    return out.select("stream", "model", "seeds", F.round("accuracy_mean", 6).alias("accuracy_mean"), "throughput_mean", "model_entries_mean")
