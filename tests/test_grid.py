import pytest
from pyspark.sql import functions as F

from driftloom.plans import grid, scenarios, specs
from driftloom.sources import sinks
from driftloom.streaming import learner


def stream(instances_of, numbers):
    """Rows of two classes; instances keep the given row numbers."""
    rows = [([f"{'ab'[i % 2]}{i % 5}", "c"], i % 2, i) for i in range(len(numbers))]
    inst = instances_of(rows)
    names = inst.sparkSession.createDataFrame(list(enumerate(numbers)), "idx long, own long")
    return inst.join(names, "idx").drop("idx").withColumnRenamed("own", "idx").select("stream", "seed", "idx", "t", "label", "bag")


def test_slices_and_holes_run_like_whole_streams(spark, instances_of):
    whole, holed = list(range(60)), [500 + 3 * i for i in range(60)]
    table = specs.spec_table(spark, {m: {"model": m} for m in ("majority", "accumulative", "informed")}, {"w": 10})
    got = []
    for numbers in (whole, holed):
        drifts = spark.createDataFrame([("s", 0, numbers[30], numbers[30])], "stream string, seed int, p long, e long")
        out = grid.run(stream(instances_of, numbers), table, drifts, 10, 5, 20)
        rows = {(r["model"], r["idx"]): (r["pred"], r["at"]) for r in out.predictions.collect()}
        assert len(rows) == 180 and all(at == numbers[idx] for (_, idx), (_, at) in rows.items())
        metrics = {r["model"]: r.asDict() for r in out.metrics.collect()}
        assert metrics["majority"]["vocab_detections"] is None and metrics["accumulative"]["rebuilds"] is None
        assert metrics["informed"]["vocab_detections"] is not None and metrics["informed"]["drift_point"] == 30
        got.append(({k: v[0] for k, v in rows.items()}, metrics))
    assert got[0] == got[1]


def test_fresh_records_share_nothing():
    one, two = learner.fresh_record(0.1), learner.fresh_record(0.1)
    one["window"]["size"][0] += 1
    one["counts"]["rows"][1] += 1
    one["past"][0].append(0.5)
    assert two == learner.fresh_record(0.1)


def test_saving_a_stream_keeps_the_others(spark, tmp_path):
    rows = spark.range(10).select(F.lit("x").alias("stream"), F.lit(0).alias("seed"), F.col("id").alias("idx"), (F.col("id") % 2).alias("label"))
    side = spark.createDataFrame([("x", 0, [5])], "stream string, seed int, drift_points array<long>")
    for name in ("x", "y"):
        sinks.save_streams(rows.withColumn("stream", F.lit(name)), side.withColumn("stream", F.lit(name)), str(tmp_path))
    assert {r["stream"] for r in spark.read.parquet(str(tmp_path / "streams")).select("stream").distinct().collect()} == {"x", "y"}
    assert spark.read.json(str(tmp_path / "drift_points")).count() == 2


def test_scenarios_refuse_small_pools(spark):
    corpus = spark.createDataFrame([(i, i, 1, "u", "school home") for i in range(20)], "idx long, id long, label int, user string, text string")
    corpus = corpus.withColumn("tokens", F.split("text", " ")).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="pools too small"):
        scenarios.build(corpus, 100, [0], ["s_sudden"])
