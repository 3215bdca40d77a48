"""Prequential model queries over the documents and events streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.operators import bayes, strategies, vocabulary
from driftloom.operators.prefix import running
from driftloom.plans import informed, specs, streams
from driftloom.session import cut

SCORE_DIGITS = 4
# Block sizes of the registered queries: small, so that several blocks are used on test data.
DOC_BLOCK, EVENT_BLOCK = 512, 4096


def doc_instances(spark, d):
    return streams.instances(streams.docs_stream(spark, d), "docs")


def event_instances(spark, d, flip=False):
    return streams.instances(streams.events_stream(spark, d, flip), "events")


def fixed_models(spark, inst, *models):
    rows = spark.createDataFrame([(m, float(lam), float(a)) for m, lam, a in models],
                                 "model string, lam double, alpha double")
    return cut(bayes.whole_stream(inst, rows), "segments")


def window_size(n: int) -> int:
    """Window of the registered detector queries: a fortieth of the stream."""
    return max(n // 40, 5)


def events_window(spark, d) -> int:
    return window_size(streams.table(spark, d, "events").count())


@query("nb_majority", sql.with_(sql.DOCS_ROWS) + """
SELECT idx, label, n0, n1, CAST(n1 > n0 AS INTEGER) AS pred FROM (
  SELECT idx, label, count(*) FILTER (label = 0) OVER p AS n0, count(*) FILTER (label = 1) OVER p AS n1
  FROM rows WINDOW p AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(spark, d):
    return bayes.majority(doc_instances(spark, d), DOC_BLOCK).select("idx", "label", "n0", "n1", "pred")


WORD_STATE_SQL = """
SELECT idx, word, k,
  CAST(coalesce(sum(CASE WHEN label = 0 THEN k END) OVER p, 0) AS BIGINT) AS m0,
  CAST(coalesce(sum(CASE WHEN label = 1 THEN k END) OVER p, 0) AS BIGINT) AS m1,
  round(max(CASE WHEN label = 0 THEN t END) OVER p, 6) AS u0, round(max(CASE WHEN label = 1 THEN t END) OVER p, 6) AS u1
FROM words JOIN rows USING (idx)
WINDOW p AS (PARTITION BY word ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("nb_word_counts", sql.with_(sql.events_rows()) + WORD_STATE_SQL)
def _(spark, d):
    inst = event_instances(spark, d)
    starts = inst.groupBy("stream", "seed").agg(F.max("idx").alias("end")).withColumn("b", F.lit(0).cast("long"))
    state = bayes.word_state(inst, starts, EVENT_BLOCK)
    return state.select("idx", "word", "k", F.col("m0").cast("long"), F.col("m1").cast("long"),
                        F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"))


def scored_columns(scored, digits=SCORE_DIGITS):
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    return scored.select(
        "model", "idx", "label", "pred", F.col("vocab").cast("long").alias("vocab"),
        F.col("entries").cast("long").alias("entries"),
        F.when(both, F.round("s0", digits)).alias("s0"), F.when(both, F.round("s1", digits)).alias("s1"))


SCORED_COLUMNS = (f"SELECT model, idx, label, pred, CAST(vocab AS BIGINT) AS vocab, CAST(entries AS BIGINT) AS entries, round(s0, {SCORE_DIGITS}) AS s0, "
                  f"round(s1, {SCORE_DIGITS}) AS s1 FROM scored")


@query("nb_vocabulary_size", sql.with_(sql.events_rows(), sql.whole_segments(("m", 0.0, 1.0)), sql.SCORED)
       + "SELECT idx, CAST(vocab AS BIGINT) AS vocab, CAST(entries AS BIGINT) AS entries FROM scored")
def _(spark, d):
    inst = event_instances(spark, d)
    scored = bayes.score(inst, fixed_models(spark, inst, ("m", 0.0, 1.0)), EVENT_BLOCK)
    return scored.select("idx", F.col("vocab").cast("long"), F.col("entries").cast("long"))


@query("nb_accumulative", sql.with_(sql.DOCS_ROWS, sql.whole_segments(("accumulative", 0.0, 1.0)), sql.SCORED) + SCORED_COLUMNS.replace(
    "round(s0, 4)", "round(s0 - ln(n0 + n1), 4)").replace("round(s1, 4)", "round(s1 - ln(n0 + n1), 4)"))
def _(spark, d):
    inst = doc_instances(spark, d)
    scored = bayes.predict(inst, fixed_models(spark, inst, ("accumulative", 0.0, 1.0)), DOC_BLOCK)
    prior = F.ln(F.col("n0") + F.col("n1"))  # the accumulative prior is a share, not a count
    return scored_columns(scored.withColumn("s0", F.col("s0") - prior).withColumn("s1", F.col("s1") - prior))


@query("nb_ageing", sql.with_(sql.DOCS_ROWS, sql.whole_segments(("ageing", 0.05, 1.0)), sql.SCORED) + SCORED_COLUMNS)
def _(spark, d):
    inst = doc_instances(spark, d)
    return scored_columns(bayes.predict(inst, fixed_models(spark, inst, ("ageing", 0.05, 1.0)), DOC_BLOCK))


@query("nb_fading_many", sql.with_(
    sql.events_rows(True), sql.whole_segments(("accumulative", 0.0, 1.0), ("fading", 0.2, 1.0), ("fast", 0.5, 0.5)), sql.SCORED)
    + SCORED_COLUMNS)
def _(spark, d):
    inst = event_instances(spark, d, True)
    segments = fixed_models(spark, inst, ("accumulative", 0.0, 1.0), ("fading", 0.2, 1.0), ("fast", 0.5, 0.5))
    return scored_columns(bayes.predict(inst, segments, EVENT_BLOCK))


def _norms(inst, segments):
    """The class normalisers themselves, before every row."""
    docs = cut(bayes.document_terms(inst, *bayes.prepare(inst, segments), EVENT_BLOCK), "terms")
    return running(docs, ["stream", "seed", "seg"], "idx", "blk", decayed={"norm0": F.col("gain0"), "norm1": F.col("gain1")},
                   age=F.expr("lam * (t - origin)"))


@query("nb_normaliser", sql.with_(sql.events_rows(), sql.whole_segments(("slow", 0.05, 1.0), ("quick", 2.0, 1.0)),
                                  # the quick rate would overflow with one reference time
                                  sql.SCORED.replace("min(r.t) OVER (PARTITION BY s.model, s.lo) AS t0",
                                                     "CASE WHEN s.lam > 1 THEN r.t ELSE min(r.t) OVER (PARTITION BY s.model, s.lo) END AS t0"))
       + "SELECT idx, round(norm0, 4) AS norm0, round(norm1, 4) AS norm1 FROM doc_state WHERE model = 'slow'")
def _(spark, d):
    inst = event_instances(spark, d)
    segments = fixed_models(spark, inst, ("slow", 0.05, 1.0), ("quick", 2.0, 1.0))
    return _norms(inst, segments).where("lam < 1").select("idx", F.round("norm0", 4).alias("norm0"), F.round("norm1", 4).alias("norm1"))


@query("nb_normaliser_rates", sql.with_(sql.events_rows(True)).rstrip() + """,
seen AS (SELECT w.idx, w.word, r.label, r.t, sum(w.k) OVER (PARTITION BY w.word, r.label ORDER BY w.idx) AS m FROM words w JOIN rows r USING (idx)),
pairs AS (SELECT DISTINCT word, label FROM seen),
held AS (
  SELECT r.idx, p.label, r.t, s.m, s.t AS u FROM (rows r CROSS JOIN pairs p) ASOF JOIN seen s ON s.word = p.word AND s.label = p.label AND s.idx < r.idx)
SELECT v.lam, r.idx, round(coalesce(sum(CASE WHEN h.label = 0 THEN m * exp(-v.lam * (h.t - u)) END), 0), 4) AS norm0,
  round(coalesce(sum(CASE WHEN h.label = 1 THEN m * exp(-v.lam * (h.t - u)) END), 0), 4) AS norm1
FROM rows r CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(40 AS DOUBLE))) AS v(lam) LEFT JOIN held h USING (idx) GROUP BY v.lam, r.idx""")
def _(spark, d):
    """Normalisers under three rates, by the definition: the quick ones pass through many frames of the age axis."""
    inst = event_instances(spark, d, True)
    found = _norms(inst, fixed_models(spark, inst, ("slow", 0.05, 1.0), ("quick", 2.0, 1.0), ("instant", 40.0, 1.0)))
    return found.select("lam", "idx", *[F.round(F.greatest(c, F.lit(0.0)), 4).alias(c) for c in ("norm0", "norm1")])


# Three rate changes and two rebuilds at fixed shares of the stream.
CHANGES_SQL = """
n AS (SELECT count(*) AS n FROM rows),
segs AS (
  SELECT 'm' AS model, b, CAST(lam AS DOUBLE) AS lam, CAST(1.0 AS DOUBLE) AS alpha, lo, hi FROM (
    SELECT 0 AS b, 0.1 AS lam, 0 AS lo, n // 8 - 1 AS hi FROM n
    UNION ALL SELECT 0, 0.4, n // 8, n // 4 - 1 FROM n UNION ALL SELECT 0, 0.0, n // 4, n // 2 - 1 FROM n
    UNION ALL SELECT n // 3, 0.2, n // 2, 3 * n // 4 - 1 FROM n UNION ALL SELECT 5 * n // 8, 0.2, 3 * n // 4, n - 1 FROM n))"""


@query("nb_rate_changes_and_rebuilds", sql.with_(sql.events_rows(True), CHANGES_SQL, sql.SCORED) + SCORED_COLUMNS)
def _(spark, d):
    inst = event_instances(spark, d, True)
    n = streams.table(spark, d, "events").count()
    rows = [(0, 0.1, 0, n // 8 - 1), (0, 0.4, n // 8, n // 4 - 1), (0, 0.0, n // 4, n // 2 - 1),
            (n // 3, 0.2, n // 2, 3 * n // 4 - 1), (5 * n // 8, 0.2, 3 * n // 4, n - 1)]
    segments = spark.createDataFrame([("events", 0, "m", b, lam, 1.0, lo, hi) for b, lam, lo, hi in rows],
                                     "stream string, seed int, model string, b long, lam double, alpha double, lo long, hi long")
    return scored_columns(bayes.predict(inst, segments, EVENT_BLOCK))


WINDOW_SQL = "(SELECT greatest(count(*) // 40, 5) FROM events)"


def detector_specs(spark, inst, w, **models):
    return cut(specs.per_cell(specs.spec_table(spark, models, {"w": w}), inst), "specs")


@query("det_windows", sql.with_(sql.events_rows(), sql.seen_words(WINDOW_SQL))
       + f"""SELECT win, class, count(*) AS words, (win + 1) * {WINDOW_SQL} - 1 AS idx FROM seen GROUP BY win, class""")
def _(spark, d):
    inst, w = event_instances(spark, d), events_window(spark, d)
    seen = vocabulary.window_words(inst, detector_specs(spark, inst, w, m={"model": "informed"}))
    return seen.groupBy("win", F.col("class"), "w").agg(F.count(F.lit(1)).alias("words")).select(
        "win", "class", "words", ((F.col("win") + 1) * F.col("w") - 1).alias("idx"))


def _precisions(spark, d, reference):
    inst, w = event_instances(spark, d), events_window(spark, d)
    det = detector_specs(spark, inst, w, m={"model": "informed", "detect_reference": reference})
    seen = cut(vocabulary.window_words(inst, det), "seen")
    return vocabulary.precisions(inst, det, seen).select(
        "win", "idx", F.round("precision_0", 6).alias("p0"), F.round("precision_1", 6).alias("p1"))


for _reference in ("previous", "accumulated"):
    query(f"det_precision_{_reference}", sql.with_(sql.events_rows(), sql.seen_words(WINDOW_SQL), sql.precisions(WINDOW_SQL, _reference))
          + f"SELECT win, (win + 1) * {WINDOW_SQL} - 1 AS idx, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM prec")(
        lambda spark, d, r=_reference: _precisions(spark, d, r))


def checks_sql(flip=False, reference="previous"):
    return sql.with_(sql.events_rows(flip), sql.seen_words(WINDOW_SQL), sql.precisions(WINDOW_SQL, reference),
                     sql.signals(WINDOW_SQL), recursive=True)


def event_checks(spark, inst, w, **models):
    det = detector_specs(spark, inst, w, **models)
    seen = cut(vocabulary.window_words(inst, det), "seen")
    return vocabulary.detect(inst, det, seen), det


@query("det_signals", checks_sql() + "SELECT win, idx, signal FROM checks")
def _(spark, d):
    inst = event_instances(spark, d)
    return event_checks(spark, inst, events_window(spark, d), m={"model": "informed"})[0].select("win", "idx", "signal")


@query("det_rebuild_interval", checks_sql() + "SELECT idx, signal, train_from, idx - train_from + 1 AS rebuild_size FROM checks WHERE signal <> 'none'")
def _(spark, d):
    inst = event_instances(spark, d)
    checks = event_checks(spark, inst, events_window(spark, d), m={"model": "informed"})[0]
    return checks.where("signal <> 'none'").select(
        "idx", "signal", "train_from", (F.col("idx") - F.col("train_from") + 1).alias("rebuild_size"))


LAMBDA_SQL = {
    "SlowIncreaseUpToALimit": """lams AS (
  SELECT win, idx, least(CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * count(*) FILTER (signal = 'change') OVER (ORDER BY win), CAST(0.5 AS DOUBLE)) AS lam FROM checks)""",
    "FastSetFastReset": """lams AS (SELECT win, idx, CAST(CASE WHEN signal = 'change' THEN 0.5 ELSE 0.1 END AS DOUBLE) AS lam FROM checks)""",
    "SlowIncreaseFastReset": """held AS (
  SELECT CAST(-1 AS BIGINT) AS win, CAST(0.1 AS DOUBLE) AS lam
  UNION ALL SELECT c.win, CASE WHEN h.lam >= 0.5 THEN CAST(0.1 AS DOUBLE) WHEN c.signal = 'change' THEN least(round(h.lam + CAST(0.1 AS DOUBLE), 12), CAST(0.5 AS DOUBLE)) ELSE h.lam END
  FROM held h JOIN checks c ON c.win = h.win + 1),
lams AS (SELECT c.win, c.idx, h.lam FROM checks c JOIN held h USING (win))""",
    "FastSetSlowDecrease": """held AS (
  SELECT CAST(-1 AS BIGINT) AS win, CAST(0.1 AS DOUBLE) AS lam
  UNION ALL SELECT c.win, CASE WHEN c.signal = 'change' THEN CAST(0.5 AS DOUBLE) WHEN h.lam > 0.1 THEN
      CASE WHEN h.lam * CAST(0.95 AS DOUBLE) > 0.1 + 1e-9 THEN h.lam * CAST(0.95 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END ELSE h.lam END
  FROM held h JOIN checks c ON c.win = h.win + 1),
lams AS (SELECT c.win, c.idx, h.lam FROM checks c JOIN held h USING (win))""",
}


def _rates(spark, d, name):
    inst = event_instances(spark, d)
    # The accumulated reference signals often, so the strategies have something to do.
    checks, det = event_checks(spark, inst, events_window(spark, d), m={
        "model": "informed", "strategy": name, "lam": 0.1, "c": 0.1, "detect_reference": "accumulated"})
    return strategies.rates(checks, det), det


for _name, _cte in LAMBDA_SQL.items():
    query(f"lam_{_name}", checks_sql(reference="accumulated").rstrip() + ",\n" + _cte + "\nSELECT win, idx, round(lam, 9) AS lam FROM lams")(
        lambda spark, d, n=_name: _rates(spark, d, n)[0].select("win", "idx", F.round("lam", 9).alias("lam")))


@query("lam_Rebuild", checks_sql(reference="accumulated") + "SELECT idx, train_from, idx - train_from + 1 AS rebuild_size FROM checks WHERE signal = 'change'")
def _(spark, d):
    rated, _ = _rates(spark, d, "Rebuild")
    return strategies.rebuilds(rated).select("idx", "train_from", (F.col("idx") - F.col("train_from") + 1).alias("rebuild_size"))


@query("lam_trace", checks_sql(reference="accumulated").rstrip() + ",\n" + LAMBDA_SQL["FastSetFastReset"] + """
SELECT 0 AS idx, CAST(0.1 AS DOUBLE) AS lam
UNION ALL SELECT idx, lam FROM (SELECT *, coalesce(lag(lam) OVER (ORDER BY win), CAST(0.1 AS DOUBLE)) AS before FROM lams) WHERE lam <> before""")
def _(spark, d):
    rated, det = _rates(spark, d, "FastSetFastReset")
    return strategies.rate_trace(rated, det).select("idx", "lam")


INFORMED_SEGMENTS = """
starts AS (
  SELECT 0 AS lo, 0 AS b, CAST(0.0 AS DOUBLE) AS lam
  UNION ALL SELECT idx + 1, train_from, CAST(0.0 AS DOUBLE) FROM checks WHERE signal = 'change'),
segs AS (
  SELECT 'baseline' AS model, b, lam, CAST(1.0 AS DOUBLE) AS alpha, lo,
    coalesce(lead(lo) OVER (ORDER BY lo), (SELECT count(*) FROM rows)) - 1 AS hi
  FROM starts WHERE lo < (SELECT count(*) FROM rows))"""
SIFR_SEGMENTS = """
held AS (
  SELECT CAST(-1 AS BIGINT) AS win, CAST(0.0 AS DOUBLE) AS lam
  UNION ALL SELECT c.win, CASE WHEN h.lam >= 0.5 THEN CAST(0.0 AS DOUBLE) WHEN c.signal = 'change' THEN least(round(h.lam + CAST(0.4 AS DOUBLE), 12), CAST(0.5 AS DOUBLE)) ELSE h.lam END
  FROM held h JOIN checks c ON c.win = h.win + 1),
lam_checks AS (SELECT c.win, c.idx, h.lam, coalesce(lag(h.lam) OVER (ORDER BY c.win), CAST(0.0 AS DOUBLE)) AS before FROM checks c JOIN held h USING (win)),
starts AS (SELECT 0 AS lo, CAST(0.0 AS DOUBLE) AS lam UNION ALL SELECT idx + 1, lam FROM lam_checks WHERE lam <> before),
segs AS (
  SELECT 'sifr' AS model, 0 AS b, lam, CAST(1.0 AS DOUBLE) AS alpha, lo,
    coalesce(lead(lo) OVER (ORDER BY lo), (SELECT count(*) FROM rows)) - 1 AS hi
  FROM starts WHERE lo < (SELECT count(*) FROM rows))"""


def informed_run(spark, d, **models):
    inst = event_instances(spark, d, True)
    det = detector_specs(spark, inst, events_window(spark, d), **models)
    return informed.run(inst, det, EVENT_BLOCK)


@query("nb_informed_rebuild", checks_sql(True).rstrip() + "," + INFORMED_SEGMENTS + "," + sql.SCORED + SCORED_COLUMNS)
def _(spark, d):
    return scored_columns(informed_run(spark, d, baseline={"model": "informed"})[0])


@query("nb_informed_rates", checks_sql(True).rstrip() + "," + SIFR_SEGMENTS + "," + sql.SCORED + SCORED_COLUMNS)
def _(spark, d):
    return scored_columns(informed_run(spark, d, sifr={
        "model": "informed", "strategy": "SlowIncreaseFastReset", "c": 0.4})[0])


@query("nb_informed_windows", checks_sql(True).rstrip() + "," + INFORMED_SEGMENTS + "," + sql.SCORED + f"""
SELECT (idx // {WINDOW_SQL}) AS win, max(idx) + 1 AS end_idx, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy
FROM scored GROUP BY 1""")
def _(spark, d):
    """Flagship: stream, detector, rebuilds, scores and accuracy per window in one plan."""
    from driftloom.plans.evaluate import windowed_accuracy
    predictions, _plan = informed_run(spark, d, baseline={"model": "informed"})
    return windowed_accuracy(predictions, ["model"], events_window(spark, d)).select(
        "win", "end_idx", F.round("accuracy", 6).alias("accuracy"))


@query("nb_informed_events", checks_sql(True) + """
SELECT idx, 'vocab' AS detector, signal AS kind, CAST(signal = 'change' AS INTEGER) AS acted, CAST(NULL AS BIGINT) AS rebuild_size FROM checks WHERE signal <> 'none'
UNION ALL SELECT idx, 'vocab', 'rebuild', NULL, idx - train_from + 1 FROM checks WHERE signal = 'change'""")
def _(spark, d):
    inst = event_instances(spark, d, True)
    det = detector_specs(spark, inst, events_window(spark, d), baseline={"model": "informed"})
    return informed.plan(inst, det).events.select("idx", "detector", "kind", F.col("acted").cast("int").alias("acted"), "rebuild_size")


@query("spc_resolution", """
SELECT s.stream, v.model, CAST(CASE WHEN v.model = 'sifr' THEN 0 WHEN s.stream = 'click' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS lam,
  CASE WHEN s.stream = 'ds1' THEN 24000 ELSE 4000 END AS w, CAST(CASE WHEN v.model = 'fading' THEN 0.1 WHEN s.stream = 'click' THEN 0.2 ELSE 0.4 END AS DOUBLE) AS c,
  CAST(1.8 AS DOUBLE) AS detect_alpha, 4000 AS confirm_window
FROM (SELECT DISTINCT event_type AS stream FROM events) s, (VALUES ('fading'), ('sifr')) AS v(model)""")
def _(spark, d):
    names = {"fading": {"model": "fading", "lam": 0.2},
             "sifr": {"model": "informed", "strategy": "SlowIncreaseFastReset", "c": 0.4, "lam_max": None}}
    overrides = {"click": {"fading": {"lam": 0.3}, "sifr": {"c": 0.2}}}
    # Streams are the event types: a control table, one spec row per (stream, model).
    found = streams.table(spark, d, "events").select(F.col("event_type").alias("stream"), F.lit(0).alias("seed")).distinct()
    table = specs.spec_table(spark, names, {"w": specs.preset_window("other")})
    special = specs.spec_table(spark, names, {"w": specs.preset_window("other")}, overrides["click"])
    both = table.crossJoin(found.where("stream <> 'click'").select("stream")).unionByName(
        special.withColumn("stream", F.lit("click")))
    return specs.per_cell(both, found).select("stream", "model", "lam", "w", "c", "detect_alpha", "confirm_window")
