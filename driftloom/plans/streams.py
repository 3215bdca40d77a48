"""Labelled streams derived from the warehouse tables, in the engine's common shape."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import clock, text
from driftloom.operators.index import dense_index
from driftloom.session import cut

BASE_COLUMNS = ["idx", "id", "ts", "label", "user", "text"]
VALUE_SPLIT = 34.6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def docs_stream(spark: SparkSession, folder: str, label: str = "toxic") -> DataFrame:
    """Labelled documents in id order; one per hour; topic is the language."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", label)
    rows = dense_index(docs.join(labels, "doc_id"), ["doc_id"])
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        "idx", F.col("doc_id").alias("id"),
        (start + F.make_dt_interval(F.lit(0), F.col("idx"))).alias("ts"),
        F.col(label).cast("byte").alias("label"), F.col("source").alias("user"), "text",
        F.col("lang").alias("topic"),
    )


def event_tokens() -> "F.Column":
    return F.array(
        F.col("event_type"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")),
        F.concat(F.lit("k"), F.from_json("props", "k int")["k"].cast("string")),
        F.concat(F.lit("v"), F.floor(F.col("value") / 25).cast("string")),
    )


def events_stream(spark: SparkSession, folder: str, flip: bool = False) -> DataFrame:
    """Events in time order with four tokens each; label = value above the split.

    With `flip`, every label inverts from the middle on: the words stay, the meaning changes.
    """
    rows = dense_index(
        table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"),
        ["ts", "event_id"])
    label = (F.col("value") > VALUE_SPLIT).cast("byte")
    if flip:
        label = clock.flip_label(label, F.col("idx") >= rows.count() // 2)
    return rows.select(
        "idx", F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        label.alias("label"), F.col("user_id").cast("string").alias("user"),
        F.concat_ws(" ", event_tokens()).alias("text"), event_tokens().alias("tokens"),
    )


def turns_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns in order; label = written by the assistant; four runs."""
    rows = dense_index(table(spark, folder, "conversations"), ["conv_id", "turn"])
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        "idx", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("idx"))).alias("ts"),
        (F.col("role") == "assistant").cast("byte").alias("label"),
        F.col("role").alias("user"), "text", (F.col("conv_id") % 4).alias("run"),
    )


def instances(stream: DataFrame, name: str, seed: int = 0, unit: str = "hour") -> DataFrame:
    """Rows ready for the models: clock, label and word bag, written once.

    Tokens are made here and nowhere later; every model and detector reads this table.
    """
    rows = stream if "tokens" in stream.columns else stream.withColumn("tokens", text.tokens(F.col("text")))
    return cut(rows.select(
        F.lit(name).alias("stream"), F.lit(seed).alias("seed"), "idx",
        clock.model_time(F.col("ts"), F.col("idx"), unit).alias("t"),
        F.col("label").cast("int").alias("label"),
        text.token_bag(F.col("tokens")).alias("bag")), "instances")
