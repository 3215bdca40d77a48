"""The training-data pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the pipeline writes it as Parquet and reads
it back as the next stage's docs. All but the last return the columns of `documents`.

- toxicity: documents that score at the threshold or above go.
- line_dedup: lines that repeat or nearly repeat an earlier line of the corpus are taken out of the texts.
- minhash: of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id stays.
  Documents whose text is empty, such as those that lost all lines, have no shingles and stay.
- decontamination: contaminated documents go.
- packing: what is left, as pieces of sequences of 2,048 tokens.

Rows without an id pass every stage but toxicity; null texts pass them all unchanged; empty tables stay empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import decontaminate, lines, minhash, packing, toxicity
from driftloom.session import checkpoint_root

#: SQL has no form of the network, the minhash groups or the tokenizer; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the network is fitted to labelled documents as they were given, not on the driver, which keeps its memory for later stages
    network = toxicity.fit_in_task(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scored(docs, network) < toxicity.THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, size=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("minhash", near_duplicates), ("decontamination", benchmark_free), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/driftloom/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
