"""File sources: raw corpus, streams, drift sidecars."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import clock
from driftloom.operators.index import dense_index

RAW_SCHEMA = "label int, id long, date string, query string, user string, text string"
SIDECAR_SCHEMA = (
    "stream string, n long, positive_share double, drift_type string, drift_points array<long>, "
    "drift_windows array<array<long>>, natural_change_point long, seed int"
)
WHOLE_STREAMS = ("ds1", "ds2")


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Header-less latin-1 CSV with fixed columns."""
    return (
        spark.read.schema(RAW_SCHEMA).option("header", False).option("encoding", "ISO-8859-1")
        .option("escape", '"').csv(path)
    )


def bad_dates(raw: DataFrame) -> DataFrame:
    """Number of rows whose date lacks the expected zone; must be 0 before indexing."""
    return raw.agg(F.count_if(~clock.has_zone_token(F.col("date"))).alias("bad_dates"))


def time_ordered(raw: DataFrame) -> DataFrame:
    """Corpus rows in arrival order with a dense index."""
    if bad_dates(raw).first()["bad_dates"]:
        raise ValueError("dates without the expected zone")
    rows = raw.select(
        "id", clock.corpus_timestamp(F.col("date")).alias("ts"),
        clock.binary_label(F.col("label")).alias("label"), "user", "text")
    return dense_index(rows, ["ts", "id", "label"]).select("idx", "id", "ts", "label", "user", "text")


def stream_name(name: str, seed: int = 0) -> str:
    return name if name in WHOLE_STREAMS else f"{name}_seed{seed}"


def read_stream(spark: SparkSession, root: str, name: str, seed: int = 0, columns=None) -> DataFrame:
    """One stream of the partitioned stream table; other partitions are not read."""
    rows = spark.read.parquet(os.path.join(root, "streams")).where(
        (F.col("stream") == name) & (F.col("seed") == (0 if name in WHOLE_STREAMS else seed)))
    return rows.select(*columns) if columns else rows


def replay_slice(stream: DataFrame, run: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows [start, start + limit) as a named run; the bounds reach the parquet scan."""
    rows = stream.where(F.col("idx") >= start)
    if limit is not None:
        rows = rows.where(F.col("idx") < start + limit)
    return rows.withColumn("run", F.lit(run))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Drift metadata of all streams below a folder (stream and seed may be its partitions) or of one file."""
    return spark.read.schema(SIDECAR_SCHEMA).option("multiLine", True).json(path)


def explode_drifts(sidecars: DataFrame) -> DataFrame:
    """(stream, seed, k, p, e, natural): one row per drift; e is the end of its window, else p; natural is the stream's
    natural change point, if it has one."""
    return (
        sidecars.select("stream", F.coalesce("seed", F.lit(0)).alias("seed"), "drift_windows",
                        F.col("natural_change_point").alias("natural"), F.posexplode("drift_points").alias("k", "p"))
        .withColumn("e", F.coalesce(F.try_element_at(F.filter(
            "drift_windows", lambda w: w[0] == F.col("p")), F.lit(1))[1], F.col("p")))
        .select("stream", "seed", "k", "p", "e", "natural")
    )
