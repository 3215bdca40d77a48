"""Token-id files: ORC with run-length encoded integers, row indexes and Bloom filters on the document ids.

`write` encodes each document once, in ascending doc_id order over the files, one file per partition; the columns are
doc_id, file_start (ids of the file before the document), part (the file's number) and ids. `read` gives the documents
back with their place in the whole sequence; a condition on doc_id is pushed to the files' indexes and Bloom filters, and
stripes are read in parallel. Null text is an empty document, a null doc_id comes first, equal ids keep all their rows,
and an empty table gives files without rows. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import text as tx
from driftloom.llm.base import query, table
from driftloom.llm.tokens import BATCH, Encoder
from driftloom.session import checkpoint_root

SCHEMA = "doc_id long, file_start long, part int, ids array<int>"
STORE = {
    "compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encode `text` of all rows and store the ids, `end` after each document."""

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, before = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in tx.parts(batches, limit=BATCH):
            ids, first = encoder.encode(batch.column("text"), end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(before + first[:-1]), pa.array(np.full(n, part, dtype=np.int32)),
                 pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "file_start", "part", "ids"])
            before += int(first[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, SCHEMA)
     .write.options(**STORE).orc(path))


def bases(stored: DataFrame) -> DataFrame:
    """part and base: the ids of all files before it (one row for each file)."""
    sizes = stored.groupBy("part").agg(F.max(F.col("file_start") + F.size("ids")).alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents: doc_id, start (ids of all documents before it), ids."""
    rows = files_of(spark, path)
    return rows.join(bases(rows), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers; the ids stay where they are read."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(data[a:b].data) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "file_start", "part")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "file_start", "part", "n_tokens", "ids_crc32"])

    rows = files_of(spark, path)
    found = rows.mapInArrow(digest, "doc_id long, file_start long, part int, n_tokens long, ids_crc32 long")
    return found.join(bases(rows), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/driftloom/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return digests(spark, path)
