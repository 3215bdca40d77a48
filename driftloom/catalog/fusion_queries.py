"""Error-channel and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.catalog.model_queries import (
    EVENT_BLOCK, WINDOW_SQL, checks_sql, detector_specs, event_checks, event_instances, events_window, fixed_models)
from driftloom.operators import adwin, bayes, fusion
from driftloom.plans import enhanced, informed, specs, streams
from driftloom.session import cut

CELL = ["stream", "seed", "model"]
COOLDOWN, MIN_REBUILD = 700, 100

# Given signals: the detector's checks, and events of high value as rises of the error rate.
SIGNALS = """
signals AS (
  SELECT 'vocab' AS detector, 1 AS turn, idx, signal, train_from, CAST(NULL AS BIGINT) AS width FROM checks
  UNION ALL SELECT 'adwin', 0, idx, 'change', NULL, CAST(floor(value) AS BIGINT) FROM ev_tokens WHERE value > 230)"""
GATED = f"""
gated AS (
  SELECT detector, turn, idx, signal, train_from, width, CASE WHEN signal <> 'none' AND idx - CASE detector
      WHEN 'adwin' THEN max(CASE WHEN detector = 'vocab' AND signal <> 'none' THEN idx END) OVER p
      ELSE max(CASE WHEN detector = 'adwin' THEN idx END) OVER p END <= {WINDOW_SQL} THEN 'change' ELSE 'none' END AS gated
  FROM signals WINDOW p AS (ORDER BY idx, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
PASSED = "gated AS (SELECT *, signal AS gated FROM signals)"
ACTED = f"""
acts AS (
  SELECT detector, min(idx) AS idx FROM gated WHERE gated = 'change' GROUP BY detector
  UNION ALL
  SELECT detector, nxt FROM (
    SELECT a.detector, (SELECT min(g.idx) FROM gated g WHERE g.detector = a.detector AND g.gated = 'change' AND g.idx >= a.idx + {COOLDOWN}) AS nxt
    FROM acts a) WHERE nxt IS NOT NULL)"""


def given(spark, d):
    """(vocabulary checks, error rises, spec table, window size) of the registered queries."""
    inst, w = event_instances(spark, d), events_window(spark, d)
    checks, det = event_checks(spark, inst, w, m={"model": "enhanced", "detect_reference": "accumulated"})
    rises = streams.events_stream(spark, d).select("idx", "id").join(
        streams.table(spark, d, "events").where("value > 230").select(F.col("event_id").alias("id"), F.floor("value").alias("width")), "id"
    ).select(F.lit("events").alias("stream"), F.lit(0).alias("seed"), F.lit("m").alias("model"), "idx", "width")
    return checks, rises, det, w


def signals_sql(*more):
    return checks_sql(reference="accumulated").rstrip() + "," + ",".join((SIGNALS, *more)) + "\n"


def acted_signals(spark, d, mode):
    checks, rises, det, w = given(spark, d)
    return cut(fusion.decide(fusion.timeline(checks, rises), mode, w, COOLDOWN), "decided"), det, w


@query("fus_and_gate", signals_sql(GATED) + "SELECT detector, idx, signal, gated FROM gated")
def _(spark, d):
    return acted_signals(spark, d, "and")[0].select("detector", "idx", "signal", "gated")


for _mode, _gate in (("or", PASSED), ("and", GATED)):
    query(f"fus_{_mode}_cooldown", signals_sql(_gate, ACTED) + """
SELECT g.detector, g.idx, CAST(a.idx IS NOT NULL AS INTEGER) AS acted FROM gated g LEFT JOIN acts a ON a.detector = g.detector AND a.idx = g.idx""")(
        lambda spark, d, m=_mode: acted_signals(spark, d, m)[0].select("detector", "idx", F.col("acted").cast("int").alias("acted")))

for _mode, _only in (("vocab_only", "vocab"), ("adwin_only", "adwin")):
    query(f"fus_{_mode}", signals_sql() + f"SELECT detector, idx, signal AS gated FROM signals WHERE detector = '{_only}'")(
        lambda spark, d, m=_mode: acted_signals(spark, d, m)[0].select("detector", "idx", "gated"))


@query("fus_rebuild_starts", signals_sql(PASSED, ACTED) + f"""
SELECT idx, detector, train_from, idx - train_from + 1 AS rebuild_size FROM (
  SELECT g.idx, g.detector, CASE g.detector WHEN 'adwin' THEN greatest(g.idx - least(greatest(g.width, {MIN_REBUILD}), 24000) + 1, 0) ELSE g.train_from END AS train_from
  FROM gated g JOIN acts a ON a.detector = g.detector AND a.idx = g.idx)""")
def _(spark, d):
    acted, _, _ = acted_signals(spark, d, "or")
    return fusion.rebuild_starts(acted, MIN_REBUILD, specs.DEFAULTS["buffer_rows"]).select("idx", "detector", "train_from", "rebuild_size")


@query("fus_fast_set", signals_sql(PASSED, ACTED) + f"""
, trace AS (SELECT 0 AS idx, CAST(0.1 AS DOUBLE) AS lam UNION ALL SELECT idx, CAST(0.1 AS DOUBLE) + CAST(win AS DOUBLE) / 100 FROM checks WHERE signal = 'change'),
raised AS (SELECT idx AS a, idx + {WINDOW_SQL} AS z FROM acts WHERE detector = 'adwin'),
marks AS (SELECT idx FROM trace UNION SELECT a FROM raised UNION SELECT z FROM raised)
SELECT idx AS from_idx, least(coalesce(lead(idx) OVER (ORDER BY idx), (SELECT count(*) FROM rows)), (SELECT count(*) FROM rows)) AS to_idx,
  round(CASE WHEN EXISTS (SELECT 1 FROM raised r WHERE r.a <= m.idx AND m.idx < r.z) THEN 0.5
    ELSE (SELECT arg_max(t.lam, t.idx) FROM trace t WHERE t.idx <= m.idx) END, 6) AS lam
FROM marks m WHERE idx < (SELECT count(*) FROM rows)""")
def _(spark, d):
    acted, det, w = acted_signals(spark, d, "or")
    start = det.select(*CELL, F.lit(0).cast("long").alias("idx"), F.lit(0.1).alias("lam"))
    changes = acted.where("detector = 'vocab' and signal = 'change'").select(
        *CELL, "idx", (F.lit(0.1) + F.floor(F.col("idx") / w).cast("double") / 100).alias("lam"))
    extent = informed.extent_of(event_instances(spark, d))
    out = fusion.fast_set(start.unionByName(changes), acted, 0.5, w, extent)
    return out.select("from_idx", "to_idx", F.round("lam", 6).alias("lam"))


@query("adw_error_packs", checks_sql().split("seen AS")[0].rstrip().rstrip(",").replace("RECURSIVE ", "") + """
SELECT idx // 32 AS word, min(idx) AS first, count(*) AS size, CAST(sum(CASE WHEN label = 1 THEN CAST(pow(2, idx % 32) AS BIGINT) ELSE 0 END) AS BIGINT) AS bits
FROM rows WHERE idx >= 1000 GROUP BY 1""")
def _(spark, d):
    rows = event_instances(spark, d).select("stream", "seed", "idx", "label", F.lit(0).alias("pred"))
    return adwin.pack_errors(rows, ["stream", "seed"], specs.DEFAULTS["warmup_rows"]).select("word", "first", "size", "bits")


@query("adw_error_rises", sql.with_(
    sql.events_rows(True), sql.whole_segments(("accumulative", 0.0, 1.0), ("fading", 0.2, 1.0)), sql.SCORED, sql.rises(), recursive=True)
    + "SELECT 'events' AS stream, 0 AS seed, model, idx, width, error_rate FROM rises")
def _(spark, d):
    """Rises of the error rate of two models on the flipped stream."""
    inst = event_instances(spark, d, True)
    segments = fixed_models(spark, inst, ("accumulative", 0.0, 1.0), ("fading", 0.2, 1.0))
    predictions = cut(bayes.predict(inst, segments, EVENT_BLOCK), "predictions")
    return adwin.error_rises(predictions, CELL, "stream string, seed int, model string")


def enhanced_run(spark, d, **models):
    inst = event_instances(spark, d, True)
    det = detector_specs(spark, inst, events_window(spark, d), **models)
    return enhanced.run(inst, det, EVENT_BLOCK)


FUSED = {"adwin_only": "adwin_only", "either": "or", "both": "and"}
#: Rounds of the SQL twin: one more than the rebuilds of its most restless model.
TWIN_ROUNDS = 8
ENHANCED_SQL = checks_sql(True).rstrip() + "," + sql.enhanced(
    FUSED, WINDOW_SQL, specs.DEFAULTS["cooldown"], specs.DEFAULTS["min_rebuild"], specs.DEFAULTS["buffer_rows"], TWIN_ROUNDS)


def fused_run(spark, d):
    return enhanced_run(spark, d, **{name: {"model": "enhanced", "fusion": fusion} for name, fusion in FUSED.items()})


@query("nb_enhanced", ENHANCED_SQL + "SELECT model, idx, label, pred, lam FROM enhanced")
def _(spark, d):
    """The fusion modes side by side, with error feedback."""
    return fused_run(spark, d).predictions.select("model", "idx", "label", "pred", "lam")


@query("nb_enhanced_log", ENHANCED_SQL + """
SELECT model, idx, detector, kind, CAST(acted AS INTEGER) AS acted, rebuild_size, width, error_rate FROM enhanced_events""")
def _(spark, d):
    """Their signals, what became of them, and the rebuilds."""
    return fused_run(spark, d).events.select(
        "model", "idx", "detector", "kind", F.col("acted").cast("int").alias("acted"), "rebuild_size", "width", "error_rate")


@query("nb_enhanced_events")
def _(spark, d):
    """Event log of the error channel with its fast-set reaction (iterative, no SQL twin)."""
    run = enhanced_run(spark, d, fastset={"model": "enhanced", "fusion": "adwin_only", "adwin_reaction": "fastset"})
    return run.events.drop("stream", "seed")


@query("nb_enhanced_vocab_only", checks_sql(True).rstrip() + "," + f"""
acts AS (
  SELECT min(idx) AS idx FROM checks WHERE signal = 'change'
  UNION ALL SELECT nxt FROM (SELECT (SELECT min(c.idx) FROM checks c WHERE c.signal = 'change' AND c.idx >= a.idx + 2000) AS nxt FROM acts a) WHERE nxt IS NOT NULL),
starts AS (
  SELECT 0 AS lo, 0 AS b UNION ALL SELECT c.idx + 1, c.train_from FROM checks c JOIN acts a ON a.idx = c.idx),
segs AS (
  SELECT 'vocab_only' AS model, b, CAST(0 AS DOUBLE) AS lam, CAST(1 AS DOUBLE) AS alpha, lo,
    coalesce(lead(lo) OVER (ORDER BY lo), (SELECT count(*) FROM rows)) - 1 AS hi
  FROM starts WHERE lo < (SELECT count(*) FROM rows)),""" + sql.SCORED + "\nSELECT model, idx, label, pred FROM scored")
def _(spark, d):
    """Without the error channel the rounds must give what the planned model gives."""
    run = enhanced_run(spark, d, vocab_only={"model": "enhanced", "fusion": "vocab_only"})
    return run.predictions.select("model", "idx", "label", "pred")
