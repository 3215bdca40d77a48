import pytest
from pyspark.sql import functions as F

from driftloom.plans import evaluate
from driftloom.session import cut

CELL = "stream string, seed int, model string"


def predictions(spark, correct):
    rows = [("s", 0, "m", i, 1, int(c)) for i, c in enumerate(correct)]
    return cut(spark.createDataFrame(rows, f"{CELL}, idx long, label int, pred int"), "predictions")


def drifts(spark, *pairs):
    return spark.createDataFrame([("s", 0, p, e) for p, e in pairs], "stream string, seed int, p long, e long")


def events(spark, *at):
    return spark.createDataFrame(
        [("s", 0, "m", i, "vocab", "change", True) for i in at], f"{CELL}, idx long, detector string, kind string, acted boolean")


def test_partial_window_is_kept(spark):
    rows = evaluate.windowed_accuracy(predictions(spark, [1, 0, 1, 1, 0]), ["model"], 2).orderBy("win").collect()
    assert [(r.end_idx, r.accuracy) for r in rows] == [(2, 0.5), (4, 1.0), (5, 0.0)]


def test_delays_misses_and_false_alarms(spark):
    cells = spark.createDataFrame([("s", 0, "m")], CELL)
    row = evaluate.detection_metrics(
        events(spark, 500, 10_050, 10_400, 35_000), drifts(spark, (10_000, 10_000), (20_000, 20_000)), F.lit(1000), cells
    ).where("view = 'vocab'").first()
    assert (row.detected, row.missed, row.false_alarms, row.mean_delay, row.detections) == (1, 1, 2, 50.0, 4)


def test_gradual_drift_extends_acceptance(spark):
    cells = spark.createDataFrame([("s", 0, "m")], CELL)
    row = evaluate.detection_metrics(
        events(spark, 48_000), drifts(spark, (30_000, 50_000)), F.lit(1000), cells).where("view = 'model'").first()
    assert (row.mean_delay, row.false_alarms) == (18_000.0, 0)


def test_recovery(spark):
    def of(correct):
        return evaluate.recovery_times(predictions(spark, correct), drifts(spark, (5000, 5000)), 500, 1024).first().recovery

    assert of([1] * 5000 + [0] * 1000 + [1] * 4000) == 975
    assert of([1] * 10_000) == 0
    assert of([1] * 5000 + [0] * 5000) is None


def test_summary_of_a_class_never_predicted(spark):
    rows = spark.createDataFrame([("m", y, 0) for y in (0, 0, 1, 1)], "model string, label int, pred int")
    r = evaluate.classification_summary(rows, ["model"]).first()
    assert (r.accuracy, r.precision_1, r.recall_1, r.f1_1) == (0.5, 0.0, 0.0, 0.0) and abs(r.f1_macro - 1 / 3) < 1e-12


def test_percentiles_by_rank(spark):
    import numpy as np

    from driftloom.operators.ranks import quantiles, with_quantiles

    r = np.random.default_rng(4)
    groups = {"a": [1.5] * 400 + list(r.normal(size=333)), "b": [7.0], None: [2.0, 4.0], "c": list(map(float, r.integers(0, 5, 50)))}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x["k"]: x for x in quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, share), rel=1e-12), (k, name)
    from pyspark.sql import functions as F
    out = with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], {"mid": ("v", 0.5)}).collect()
    assert {x["k"]: x["mid"] for x in out}["empty"] is None and len(out) == 5
