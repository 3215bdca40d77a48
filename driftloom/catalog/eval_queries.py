"""Evaluation and report queries over per-cell predictions derived from the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.catalog.text_queries import scratch
from driftloom.operators.sampling import ordinal_by_index
from driftloom.plans import evaluate, report, streams
from driftloom.session import cut
from driftloom.sources import sinks

CELL = ["stream", "seed", "model"]
W, TOL, REC = 50, 100, 50
MODELS = ("baseline", "enhanced", "majority")

# preds(stream, seed, model, idx, n, label, pred, ts), drifts, log (events), all from `events`.
FIXTURE = sql.EVENTS + f""",
cell_rows AS (
  SELECT event_type AS stream, CAST(user_id % 2 AS INTEGER) AS seed, k, label, ts,
    row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY idx) - 1 AS idx,
    count(*) OVER (PARTITION BY event_type, user_id % 2) AS n FROM ev_tokens),
preds AS (
  SELECT stream, seed, model, idx, n, label, ts, CASE WHEN model = 'majority' THEN 0 WHEN wrong THEN 1 - label ELSE label END AS pred
  FROM (SELECT *, CASE model
      WHEN 'baseline' THEN CASE WHEN idx >= n // 2 AND idx < 5 * n // 8 THEN k % 3 <> 0 ELSE k % 4 = 0 END
      WHEN 'enhanced' THEN CASE WHEN idx >= n // 2 AND idx < 9 * n // 16 THEN k % 3 <> 0 ELSE k % 5 = 0 END
      ELSE FALSE END AS wrong FROM cell_rows, (VALUES ('baseline'), ('enhanced'), ('majority')) AS m(model))),
drifts AS (
  SELECT DISTINCT stream, seed, n // 2 AS p, n // 2 + n // 8 AS e FROM cell_rows
  UNION ALL SELECT DISTINCT stream, seed, 3 * n // 4, 3 * n // 4 FROM cell_rows),
win_error AS (
  SELECT stream, seed, model, idx // {W} AS win, max(idx) AS idx, avg(CAST(pred <> label AS INTEGER)) AS err FROM preds GROUP BY ALL),
moves AS (SELECT *, round(err - lag(err) OVER (PARTITION BY stream, seed, model ORDER BY win), 9) AS d FROM win_error),
raised AS (
  SELECT stream, seed, model, idx, CASE WHEN d > 0 THEN 'adwin' ELSE 'vocab' END AS detector,
    CASE WHEN abs(d) > 0.12 THEN 'change' ELSE 'warning' END AS kind, abs(d) > 0.12 AND win % 3 > 0 AS acted
  FROM moves WHERE abs(d) > 0.06),
log AS (
  SELECT * FROM raised UNION ALL SELECT stream, seed, model, idx, detector, 'rebuild', NULL FROM raised WHERE acted)"""


def predictions(spark, d):
    e = ordinal_by_index(
        streams.events_stream(spark, d).select(
            F.get("tokens", F.lit(0)).alias("stream"), (F.col("user").cast("long") % 2).cast("int").alias("seed"),
            "idx", "ts", F.col("label").cast("int").alias("label"),
            F.substring(F.get("tokens", F.lit(2)), 2, 10).cast("int").alias("k")),
        ["stream", "seed"]).drop("idx").withColumnRenamed("ordinal", "idx")
    e = cut(e, "cells")
    n = e.groupBy("stream", "seed").agg(F.count(F.lit(1)).alias("n"))
    rows = e.join(n, ["stream", "seed"]).withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    i, k, size = F.col("idx"), F.col("k"), F.col("n")
    late = i >= F.floor(size / 2)
    wrong = F.when(
        F.col("model") == "baseline",
        F.when(late & (i < F.floor(5 * size / 8)), k % 3 != 0).otherwise(k % 4 == 0)
    ).otherwise(F.when(late & (i < F.floor(9 * size / 16)), k % 3 != 0).otherwise(k % 5 == 0))
    pred = F.when(F.col("model") == "majority", 0).when(wrong, 1 - F.col("label")).otherwise(F.col("label"))
    return cut(rows.select(*CELL, "idx", "n", "label", "ts", pred.alias("pred")), "predictions")


def drifts_of(preds):
    n = preds.select("stream", "seed", "n").distinct()
    half, three = F.floor(F.col("n") / 2), F.floor(3 * F.col("n") / 4)
    return n.select("stream", "seed", F.explode(F.array(
        F.struct(half.alias("p"), (half + F.floor(F.col("n") / 8)).alias("e")),
        F.struct(three.alias("p"), three.alias("e")))).alias("x")).select("stream", "seed", "x.p", "x.e")


def log_of(preds):
    errors = preds.groupBy(*CELL, F.floor(F.col("idx") / W).alias("win")).agg(
        F.max("idx").alias("idx"), F.avg((F.col("pred") != F.col("label")).cast("int")).alias("err"))
    d = F.round(F.col("err") - F.lag("err").over(Window.partitionBy(*CELL).orderBy("win")), 9)
    moves = errors.withColumn("d", d).where(F.abs("d") > 0.06)
    change = F.abs("d") > 0.12
    raised = moves.select(
        *CELL, "idx", F.when(F.col("d") > 0, "adwin").otherwise("vocab").alias("detector"),
        F.when(change, "change").otherwise("warning").alias("kind"), (change & (F.col("win") % 3 > 0)).alias("acted"))
    rebuilt = raised.where("acted").withColumn("kind", F.lit("rebuild")).withColumn("acted", F.lit(None).cast("boolean"))
    return cut(raised.unionByName(rebuilt), "event-log")


SUMMARY_COLUMNS = """count(*) AS n, avg(CAST(pred = label AS INTEGER)) AS accuracy,
  coalesce(count(*) FILTER (pred = 0 AND label = 0) / nullif(CAST(count(*) FILTER (pred = 0) AS DOUBLE), 0), 0) AS p0,
  coalesce(count(*) FILTER (pred = 1 AND label = 1) / nullif(CAST(count(*) FILTER (pred = 1) AS DOUBLE), 0), 0) AS p1,
  coalesce(count(*) FILTER (pred = 0 AND label = 0) / nullif(CAST(count(*) FILTER (label = 0) AS DOUBLE), 0), 0) AS r0,
  coalesce(count(*) FILTER (pred = 1 AND label = 1) / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE), 0), 0) AS r1"""
F1 = "coalesce(2 * p{c} * r{c} / nullif(p{c} + r{c}, 0), 0)"
VIEWS = """
found AS (
  SELECT stream, seed, model, idx, 'model' AS view FROM log WHERE coalesce(acted, FALSE)
  UNION ALL SELECT stream, seed, model, idx, detector FROM log WHERE kind = 'change')"""
DELAYS = f"""
cells AS (SELECT DISTINCT stream, seed, model FROM preds),
delays AS (
  SELECT c.stream, c.seed, c.model, v.view, d.p,
    (SELECT min(f.idx) FROM found f WHERE f.stream = c.stream AND f.seed = c.seed AND f.model = c.model
      AND f.view = v.view AND f.idx >= d.p AND f.idx < d.e + {TOL}) - d.p AS delay
  FROM cells c JOIN drifts d ON d.stream = c.stream AND d.seed = c.seed, (VALUES ('model'), ('vocab'), ('adwin')) AS v(view))"""
FALSE_ALARMS = f"""
wrong AS (
  SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM drifts d WHERE d.stream = f.stream AND d.seed = f.seed
    AND f.idx >= d.p AND f.idx < d.e + {TOL}))"""
RECOVERY = f"""
marks AS (
  SELECT stream, seed, p, coalesce(lag(p) OVER q, 0) AS prev, lead(p) OVER q AS nxt FROM drifts
  WINDOW q AS (PARTITION BY stream, seed ORDER BY p)),
sums AS (
  SELECT stream, seed, model, idx, n, CAST(pred = label AS INTEGER) AS ok,
    sum(CAST(pred = label AS INTEGER)) OVER (PARTITION BY stream, seed, model ORDER BY idx ROWS BETWEEN CURRENT ROW AND {REC - 1} FOLLOWING) AS ahead FROM preds),
targets AS (
  SELECT c.stream, c.seed, c.model, m.p, m.nxt, greatest(m.prev, m.p - 5 * {REC}) AS lo,
    CAST(0.95 AS DOUBLE) * (SELECT avg(s.ok) FROM sums s WHERE s.stream = c.stream AND s.seed = c.seed AND s.model = c.model
      AND s.idx >= greatest(m.prev, m.p - 5 * {REC}) AND s.idx < m.p) AS target
  FROM cells c JOIN marks m ON m.stream = c.stream AND m.seed = c.seed),
recovery AS (
  SELECT t.stream, t.seed, t.model, t.p, CASE WHEN t.p - t.lo >= {REC} THEN (SELECT min(s.idx) FROM sums s
      WHERE s.stream = t.stream AND s.seed = t.seed AND s.model = t.model AND s.idx >= t.p
      AND s.idx <= coalesce(t.nxt, s.n) - {REC} AND s.ahead / CAST({REC} AS DOUBLE) >= t.target) - t.p END AS recovery
  FROM targets t)"""
GRID = FIXTURE + "," + VIEWS + "," + DELAYS + "," + FALSE_ALARMS + "," + RECOVERY + f""",
quality AS (
  SELECT *, (p0 + p1) / 2 AS precision_macro, (r0 + r1) / 2 AS recall_macro, ({F1.format(c=0)} + {F1.format(c=1)}) / 2 AS f1_macro
  FROM (SELECT stream, seed, model, {SUMMARY_COLUMNS} FROM preds GROUP BY ALL)),
sides AS (
  SELECT stream, seed, model, avg(CAST(pred = label AS INTEGER)) FILTER (idx < 3 * n // 4) AS accuracy_pre_drift,
    avg(CAST(pred = label AS INTEGER)) FILTER (idx >= 3 * n // 4) AS accuracy_post_drift, max(3 * n // 4) AS drift_point
  FROM preds GROUP BY ALL),
found_by AS (
  SELECT stream, seed, model, view, count(delay) AS detected, count(*) - count(delay) AS missed, avg(delay) AS mean_delay FROM delays GROUP BY ALL),
blocks AS (
  SELECT stream, seed, model, {', '.join(
    f"max(detections) FILTER (view = '{v}') AS {v}_detections, max(detected) FILTER (view = '{v}') AS {v}_detected, "
    f"max(missed) FILTER (view = '{v}') AS {v}_missed, max(alarms) FILTER (view = '{v}') AS {v}_false_alarms, "
    f"max(mean_delay) FILTER (view = '{v}') AS {v}_mean_delay" for v in evaluate.DETECTORS)}
  FROM (SELECT b.*, (SELECT count(*) FROM found f WHERE f.stream = b.stream AND f.seed = b.seed AND f.model = b.model AND f.view = b.view) AS detections,
     (SELECT count(*) FROM wrong f WHERE f.stream = b.stream AND f.seed = b.seed AND f.model = b.model AND f.view = b.view) AS alarms FROM found_by b) GROUP BY ALL),
rolled AS (
  SELECT stream, seed, model, avg(recovery) AS recovery_mean, max(recovery) AS recovery_max, count(*) - count(recovery) AS not_recovered,
    '[' || string_agg(coalesce(CAST(recovery AS VARCHAR), 'null'), ', ' ORDER BY p) || ']' AS recovery_per_drift, count(*) AS n_drifts FROM recovery GROUP BY ALL),
spans AS (SELECT stream, seed, model, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1e6 AS DOUBLE)) AS throughput,
  CAST(count(DISTINCT label * 1000 + idx % 97) AS DOUBLE) AS model_entries, quantile_cont(CAST(idx % 97 AS DOUBLE), CAST(0.95 AS DOUBLE)) AS batch_ms_p95 FROM preds GROUP BY ALL),
grid AS (
  SELECT q.stream, q.seed, q.model, q.n, r.n_drifts, s.drift_point, q.accuracy, q.precision_macro, q.recall_macro, q.f1_macro,
    s.accuracy_pre_drift, s.accuracy_post_drift, b.* EXCLUDE (stream, seed, model),
    (SELECT count(*) FROM log l WHERE l.stream = q.stream AND l.seed = q.seed AND l.model = q.model AND l.kind = 'rebuild') AS rebuilds,
    r.recovery_mean, r.recovery_max, r.not_recovered, r.recovery_per_drift, z.throughput, z.model_entries, z.batch_ms_p95
  FROM quality q JOIN sides s USING (stream, seed, model) JOIN blocks b USING (stream, seed, model)
  JOIN rolled r USING (stream, seed, model) JOIN spans z USING (stream, seed, model))"""

METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "accuracy_pre_drift", "accuracy_post_drift",
           *[f"{v}_mean_delay" for v in evaluate.DETECTORS], "recovery_mean"]
COUNTS = ["n", "n_drifts", "drift_point", *[f"{v}_{f}" for v in evaluate.DETECTORS for f in ("detections", "detected", "missed", "false_alarms")],
          "rebuilds", "recovery_max", "not_recovered", "recovery_per_drift"]


def grid_of(spark, d):
    """The metrics row of every cell, with event-time throughput and stand-in size and batch cost."""
    preds = predictions(spark, d)
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(1e6)
    sizes = preds.groupBy(*CELL).agg(
        (F.count(F.lit(1)) / span).alias("throughput"),
        F.count_distinct(F.col("label") * 1000 + F.col("idx") % 97).cast("double").alias("model_entries"),
        F.percentile((F.col("idx") % 97).cast("double"), 0.95).alias("batch_ms_p95"))
    grid = evaluate.metrics_row(preds, log_of(preds), drifts_of(preds), TOL, REC)
    return cut(grid.join(sizes, CELL), "grid")


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("eva_windowed_accuracy", sql.with_(FIXTURE) + f"""
SELECT stream, seed, model, least((idx // 300 + 1) * 300, max(n)) AS end_idx, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy
FROM preds GROUP BY stream, seed, model, idx // 300""")
def _(spark, d):
    out = evaluate.windowed_accuracy(predictions(spark, d), CELL, 300)
    return rounded(out.drop("win"), "accuracy")


@query("eva_windowed_share", sql.with_(FIXTURE) + """
SELECT stream, seed, idx // 300 AS win, (idx // 300 + CAST(0.5 AS DOUBLE)) * 300 AS mid, round(avg(label), 6) AS share
FROM cell_rows GROUP BY stream, seed, idx // 300 HAVING count(*) = 300""")
def _(spark, d):
    rows = predictions(spark, d).where("model = 'majority'")
    return rounded(evaluate.windowed_share(rows, ["stream", "seed"], 300, share=F.col("label")), "share")


@query("eva_classification", sql.with_(FIXTURE) + f"""
SELECT stream, seed, model, n, round(accuracy, 6) AS accuracy, round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round({F1.format(c=0)}, 6) AS f1_0,
  round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round({F1.format(c=1)}, 6) AS f1_1, round((p0 + p1) / 2, 6) AS precision_macro,
  round((r0 + r1) / 2, 6) AS recall_macro, round(({F1.format(c=0)} + {F1.format(c=1)}) / 2, 6) AS f1_macro
FROM (SELECT stream, seed, model, {SUMMARY_COLUMNS} FROM preds GROUP BY ALL)""")
def _(spark, d):
    out = evaluate.classification_summary(predictions(spark, d), CELL)
    return rounded(out, *[c for c in out.columns if c not in (*CELL, "n")])


@query("eva_before_after", sql.with_(FIXTURE) + """
SELECT stream, seed, model, CASE WHEN idx < 3 * n // 4 THEN 'pre' ELSE 'post' END AS side, count(*) AS n,
  round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM preds GROUP BY ALL""")
def _(spark, d):
    preds = predictions(spark, d)
    out = evaluate.split_summary(preds, evaluate.main_points(drifts_of(preds)), CELL)
    return rounded(out.select(*CELL, "side", "n", "accuracy"), "accuracy")


@query("eva_detections", sql.with_(FIXTURE, VIEWS) + "SELECT stream, seed, model, view, idx FROM found")
def _(spark, d):
    return evaluate.detections(log_of(predictions(spark, d))).select(*CELL, "view", "idx")


@query("eva_delays", sql.with_(FIXTURE, VIEWS, DELAYS) + "SELECT stream, seed, model, view, p, delay FROM delays")
def _(spark, d):
    preds = predictions(spark, d)
    cells = preds.select(*CELL).distinct()
    return evaluate.detection_delays(evaluate.detections(log_of(preds)), drifts_of(preds), F.lit(TOL), cells).drop("e")


@query("eva_false_alarms", sql.with_(FIXTURE, VIEWS, FALSE_ALARMS) + "SELECT stream, seed, model, view, idx FROM wrong")
def _(spark, d):
    preds = predictions(spark, d)
    return evaluate.false_alarms(evaluate.detections(log_of(preds)), drifts_of(preds), F.lit(TOL)).select(*CELL, "view", "idx")


@query("eva_recovery", sql.with_(FIXTURE, DELAYS.split("delays AS")[0].rstrip().rstrip(","), RECOVERY) + "SELECT stream, seed, model, p, recovery FROM recovery")
def _(spark, d):
    preds = predictions(spark, d)
    return evaluate.recovery_times(preds, drifts_of(preds), REC, block_rows=256)


@query("eva_recovery_rollup", sql.with_(GRID) + "SELECT stream, seed, model, round(recovery_mean, 6) AS recovery_mean, recovery_max, not_recovered, recovery_per_drift FROM rolled")
def _(spark, d):
    preds = predictions(spark, d)
    out = evaluate.recovery_rollup(evaluate.recovery_times(preds, drifts_of(preds), REC, block_rows=256))
    return rounded(out, "recovery_mean")


@query("eva_metrics_row", sql.with_(GRID) + f"SELECT stream, seed, model, {', '.join(COUNTS)}, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM grid")
def _(spark, d):
    return rounded(grid_of(spark, d).select(*CELL, *COUNTS, *METRICS), *METRICS)


BATCHES = FIXTURE + """,
batches AS (
  SELECT stream || '-' || CAST(seed AS VARCHAR) AS run, model, idx // 100 AS batch, count(*) AS n,
    count(*) FILTER (pred = label) AS right_n, sum(idx % 13 + 1) AS ms FROM preds GROUP BY ALL)"""


def _batches(spark, d):
    return predictions(spark, d).groupBy(
        F.concat("stream", F.lit("-"), F.col("seed").cast("string")).alias("run"), "model", F.floor(F.col("idx") / 100).alias("batch")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("right"), F.sum(F.col("idx") % 13 + 1).alias("ms"))


@query("eva_batch_accuracy", sql.with_(BATCHES) + """
SELECT run, model, batch, n, round(right_n / CAST(n AS DOUBLE), 6) AS accuracy,
  round(sum(right_n) OVER p / CAST(sum(n) OVER p AS DOUBLE), 6) AS accuracy_cum, CAST(sum(n) OVER p AS BIGINT) AS seen
FROM batches WINDOW p AS (PARTITION BY run, model ORDER BY batch)""")
def _(spark, d):
    return rounded(evaluate.batch_metrics(_batches(spark, d)), "accuracy", "accuracy_cum")


@query("eva_batch_cost", sql.with_(BATCHES) + """
SELECT model, round(1000 * sum(ms) / CAST(sum(n) AS DOUBLE), 6) AS ms_per_1k, round(median(CAST(ms AS DOUBLE)), 6) AS batch_ms_p50,
  round(quantile_cont(CAST(ms AS DOUBLE), CAST(0.95 AS DOUBLE)), 6) AS batch_ms_p95, round(1000 * sum(n) / CAST(sum(ms) AS DOUBLE), 6) AS throughput
FROM batches GROUP BY model""")
def _(spark, d):
    out = evaluate.cost_summary(_batches(spark, d), ["model"])
    return rounded(out, "ms_per_1k", "batch_ms_p50", "batch_ms_p95", "throughput")


def grid_query(name, select, digits=6):
    """A report over the grid: Spark query and its SQL over the same grid CTE."""
    def register(fn):
        def run(spark, d):
            out = fn(spark, d, grid_of(spark, d))
            return rounded(out, *[f.name for f in out.schema if f.dataType.typeName() == "double"], digits=digits)
        query(name, sql.with_(GRID) + select)(run)
        return fn
    return register


def _agg(expressions, digits=6):
    return ", ".join(f"round({e}, {digits}) AS {a}" for a, e in expressions.items())


@grid_query("rpt_missing_cells", """
SELECT s.stream, s.seed, m.model FROM (SELECT DISTINCT stream, seed FROM grid) s, (VALUES ('baseline'), ('enhanced'), ('majority'), ('other')) AS m(model)
WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.stream = s.stream AND g.seed = s.seed AND g.model = m.model AND g.accuracy > 0.5)""")
def _(spark, d, grid):
    return report.missing_cells(
        grid.where("accuracy > 0.5"), grid.select("stream", "seed").distinct(), [*MODELS, "other"])


_STATS = {f"{m}_{s}": f"{f}({m})" for m in report.SUMMARY_METRICS for s, f in (("mean", "avg"), ("std", "stddev_samp"))}


@grid_query("rpt_grid_summary", f"SELECT stream, model, count(*) AS seeds, {_agg(_STATS)} FROM grid GROUP BY ALL")
def _(spark, d, grid):
    return report.grid_summary(grid)


@grid_query("rpt_accuracy_pivot", "SELECT stream, " + ", ".join(f"round(avg(accuracy) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS) + " FROM grid GROUP BY 1")
def _(spark, d, grid):
    return report.accuracy_pivot(grid, list(MODELS))


@query("rpt_sweep_plan", """
SELECT v.event_type AS stream, CAST(v.seed AS INTEGER) AS seed, x.setting, x.model, x.fusion, CAST(x.delta AS DOUBLE) AS adwin_delta, CAST(x.alpha AS DOUBLE) AS detect_alpha
FROM (SELECT DISTINCT event_type, user_id % 3 AS seed FROM events) v, (
  SELECT 'baseline a=' || a AS setting, 'informed' AS model, NULL AS fusion, NULL AS delta, a AS alpha FROM (VALUES ('1.5'), ('1.8'), ('2.5')) AS t(a)
  UNION ALL SELECT 'adwin_only d=' || d, 'enhanced', 'adwin_only', d, NULL FROM (VALUES ('0.002'), ('0.01'), ('0.05')) AS t(d)
  UNION ALL SELECT f || ' d=' || d || ' a=' || a, 'enhanced', f, d, a FROM (VALUES ('or'), ('and')) AS t1(f), (VALUES ('0.002'), ('0.01'), ('0.05')) AS t2(d),
    (VALUES ('1.5'), ('1.8'), ('2.5')) AS t3(a)) x""")
def _(spark, d):
    cells = streams.table(spark, d, "events").select(
        F.col("event_type").alias("stream"), (F.col("user_id") % 3).cast("int").alias("seed")).distinct()
    return report.sweep_plan(cells)


@grid_query("rpt_sweep_summary", """
SELECT model AS setting, 'k' AS kind, round(avg(accuracy), 6) AS accuracy, round(avg(f1_macro), 6) AS f1_macro, round(avg(model_mean_delay), 6) AS mean_delay,
  CAST(sum(model_false_alarms) AS BIGINT) AS false_alarms, CAST(sum(model_missed) AS BIGINT) AS missed, round(avg(recovery_mean), 6) AS recovery_mean,
  CAST(sum(not_recovered) AS BIGINT) AS not_recovered, count(*) AS runs FROM grid GROUP BY model ORDER BY avg(accuracy) DESC""")
def _(spark, d, grid):
    return report.sweep_summary(grid.withColumnRenamed("model", "setting").withColumn("kind", F.lit("k")), ["kind"])


@grid_query("rpt_best_model", "SELECT stream, arg_max(model, row(accuracy, model)) AS model, round(max(accuracy), 6) AS accuracy FROM grid GROUP BY 1")
def _(spark, d, grid):
    return report.best_model(grid)


@query("rpt_rate_steps", sql.with_(FIXTURE) + """
SELECT stream, seed, model, idx AS from_idx, coalesce(lead(idx) OVER (PARTITION BY stream, seed, model ORDER BY idx), n) AS to_idx, lam FROM (
  SELECT l.stream, l.seed, l.model, l.idx, CAST(l.idx % 7 AS DOUBLE) AS lam, c.n FROM log l JOIN (SELECT DISTINCT stream, seed, n FROM cell_rows) c USING (stream, seed)
  WHERE kind = 'rebuild')""")
def _(spark, d):
    preds = predictions(spark, d)
    trace = log_of(preds).where("kind = 'rebuild'").select(*CELL, "idx", (F.col("idx") % 7).cast("double").alias("lam"))
    return report.rate_steps(trace, preds.select("stream", "seed", "n").distinct())


@query("rpt_detections_between", sql.with_(FIXTURE) + "SELECT stream, seed, model, idx FROM log WHERE detector = 'adwin' AND kind = 'change' AND idx BETWEEN 200 AND 700")
def _(spark, d):
    return report.detections_between(log_of(predictions(spark, d)), "adwin", 200, 700).select(*CELL, "idx")


@grid_query("rpt_delay_table", """
SELECT b.stream, coalesce(CAST(CAST(trunc(b.d) AS BIGINT) AS VARCHAR), 'not detected') AS vocab_delay, coalesce(CAST(CAST(trunc(e.d) AS BIGINT) AS VARCHAR), 'not detected') AS adwin_delay
FROM (SELECT stream, avg(vocab_mean_delay) AS d FROM grid WHERE model = 'baseline' GROUP BY 1) b
LEFT JOIN (SELECT stream, avg(adwin_mean_delay) AS d FROM grid WHERE model = 'enhanced' GROUP BY 1) e USING (stream)""")
def _(spark, d, grid):
    return report.delay_table(grid, "baseline", "enhanced")


@query("rpt_accuracy_band", sql.with_(FIXTURE) + """
SELECT stream, model, end_idx, round(avg(accuracy), 6) AS mean, round(min(accuracy), 6) AS low, round(max(accuracy), 6) AS high FROM (
  SELECT stream, seed, model, least((idx // 100 + 1) * 100, max(n)) AS end_idx, avg(CAST(pred = label AS INTEGER)) AS accuracy
  FROM preds GROUP BY stream, seed, model, idx // 100) GROUP BY ALL""")
def _(spark, d):
    return rounded(report.accuracy_band(evaluate.windowed_accuracy(predictions(spark, d), CELL, 100)), "mean", "low", "high")


@grid_query("rpt_detection_aggregates", "SELECT stream, model, " + _agg({
    "delay": "avg(model_mean_delay)", "false_alarms": "avg(model_false_alarms)", "missed_share": "sum(model_missed) / CAST(sum(n_drifts) AS DOUBLE)"}) + " FROM grid GROUP BY ALL")
def _(spark, d, grid):
    return report.detection_aggregates(grid)


@grid_query("rpt_recovery_aggregates", "SELECT stream, model, " + _agg({"mean": "avg(recovery_mean)", "low": "min(recovery_mean)", "high": "max(recovery_mean)"})
            + ", CASE WHEN sum(not_recovered) = sum(n_drifts) THEN 'never' ELSE 'recovers' END AS outcome FROM grid GROUP BY ALL")
def _(spark, d, grid):
    return report.recovery_aggregates(grid)


@grid_query("rpt_fusion_gain", """
SELECT stream, round((avg(accuracy) FILTER (model = 'enhanced') - avg(accuracy) FILTER (model = 'baseline')) * 100, 6) AS gain_enhanced,
  round((avg(accuracy) FILTER (model = 'majority') - avg(accuracy) FILTER (model = 'baseline')) * 100, 6) AS gain_majority FROM grid GROUP BY 1""")
def _(spark, d, grid):
    return report.fusion_gain(grid, "baseline", ["enhanced", "majority"])


@grid_query("rpt_detection_totals", "SELECT model, CAST(sum(model_detected) AS BIGINT) AS detected, CAST(sum(model_false_alarms) AS BIGINT) AS false_alarms, CAST(sum(n_drifts) AS BIGINT) AS drifts FROM grid GROUP BY 1")
def _(spark, d, grid):
    return report.detection_totals(grid)


@grid_query("rpt_accuracy_table", """
SELECT model, stream, printf('%.1f', round(avg(accuracy) * 100, 1)) || ' ± ' || printf('%.1f', round(stddev_pop(accuracy) * 100, 1)) AS cell FROM grid GROUP BY ALL""")
def _(spark, d, grid):
    return report.accuracy_table(grid)


@grid_query("rpt_main_table", "SELECT model, " + _agg({
    "precision": "avg(precision_macro)", "recall": "avg(recall_macro)", "f1": "avg(f1_macro)", "delay": "avg(model_mean_delay)",
    "recovery": "avg(recovery_mean)", "entries": "avg(model_entries)", "throughput": "avg(throughput)", "batch_p95": "avg(batch_ms_p95)", "acc_scenarios": "avg(accuracy) FILTER (stream NOT IN ('click', 'view'))",
    "acc_click": "avg(accuracy) FILTER (stream = 'click')", "acc_view": "avg(accuracy) FILTER (stream = 'view')"})
    + ", CAST(sum(model_detected) AS BIGINT) AS detected, CAST(sum(n_drifts) AS BIGINT) AS drifts, CAST(sum(model_false_alarms) AS BIGINT) AS false_alarms, "
      "CAST(sum(not_recovered) AS BIGINT) AS not_recovered FROM grid GROUP BY 1")
def _(spark, d, grid):
    return report.main_table(grid, {"click": "click", "view": "view"})


@grid_query("rpt_cost_table", "SELECT model, " + _agg({"throughput": "avg(throughput)", "batch_p50": "avg(batch_ms_p95) / 2", "batch_p95": "avg(batch_ms_p95)", "entries": "avg(model_entries)",
            "stream_ms_per_1k": "avg(recall_macro) * 10", "stream_accuracy": "max(accuracy)"}) + " FROM grid GROUP BY 1")
def _(spark, d, grid):
    bench = grid.groupBy("model").agg((F.avg("recall_macro") * 10).alias("ms_per_1k"), F.max("accuracy").alias("accuracy"))
    caps = F.inline(F.array(*[F.struct(F.lit(c).alias("batch_cap"), F.lit(r).alias("target_rate"))
                              for c, r in ((1000, 1000), (5000, 4000))]))
    return report.cost_table(grid.withColumn("batch_ms_p50", F.col("batch_ms_p95") / 2), bench.select("*", caps), 1000, 1000)


@query("rpt_hourly_counts", """
SELECT epoch_us(g.hour) AS hour_us, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM (
  SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM events) g
LEFT JOIN (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (value > 34.6) AS pos, count(*) FILTER (NOT value > 34.6) AS neg FROM events GROUP BY 1) h ON h.hour = g.hour""")
def _(spark, d):
    rows = streams.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 34.6).cast("int").alias("label"))
    return report.hourly_counts(rows).select(F.unix_micros("hour").alias("hour_us"), "pos", "neg")


@query("rpt_hours_with_data", """
SELECT count(DISTINCT date_trunc('hour', ts)) AS active, date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS hours FROM events""")
def _(spark, d):
    rows = streams.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 34.6).cast("int").alias("label"))
    return report.hours_with_data(report.hourly_counts(rows))


@query("rpt_corpus_facts", sql.with_(sql.EVENTS) + """
SELECT count(*) AS n, printf('%.1f', round(avg(label) * 100, 1)) AS positive, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  count(*) - max(CASE WHEN label = 1 THEN idx END) - 1 AS tail FROM ev_tokens""")
def _(spark, d):
    out = report.corpus_facts(streams.events_stream(spark, d))
    return out.select("n", "positive", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"),
                      F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "tail")


@query("snk_results_csv", sql.with_(FIXTURE) + """
SELECT stream, seed, model, least((idx // 300 + 1) * 300, max(n)) AS end_idx, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy
FROM preds GROUP BY stream, seed, model, idx // 300""")
def _(spark, d):
    """Result tables written as CSV under a partial-run name and read back."""
    root = scratch(spark, "results")
    windows = rounded(evaluate.windowed_accuracy(predictions(spark, d), CELL, 300).drop("win"), "accuracy")
    sinks.save_results({"grid_windows": windows}, root, partial=True)
    return spark.read.schema(windows.schema).option("header", True).csv(sinks.result_path(root, "grid_windows", True))


@query("snk_run_detail", sql.with_(FIXTURE) + "SELECT stream || '-' || model AS run, idx, detector, kind FROM log WHERE seed = 1")
def _(spark, d):
    """Events of each run written as JSON, one folder per run, and read back."""
    root = scratch(spark, "detail")
    log = log_of(predictions(spark, d)).where("seed = 1").withColumn("run", F.concat_ws("-", "stream", "model"))
    events = log.select("run", "idx", "detector", "kind")
    trace = log.select("run", "idx", F.lit(0.0).alias("lam"))
    sinks.save_run_detail(events, trace, log.select("run", "idx"), root)
    return spark.read.schema("idx long, detector string, kind string, run string").json(f"{root}/events")
