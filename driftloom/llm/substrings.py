"""Removal of passages that an earlier document has: fixed-block anchors.

Each document is cut into non-overlapping reference blocks of half a window (25 words). A window of 50 words holds at
least one whole block of any document that it occurs in, so a repeat shows as a rolling window of 25 words in one document
that equals a reference block of another. Blocks become a bit set of fixed size; every rolling window probes it while the
documents are read, and what passes meets the blocks by hash, where only the least and greatest document of a hash are
kept: no pairs. Around each anchor that two documents share the windows of 50 words are taken, in both; a window's first
document is the least id of its 128-bit hash, and adjacent removed windows grow together to maximal repeats.

Whole copies of a document's word sequence are found first and lose all their words; they need no windows. Documents are
compared by doc_id; rows of the same id are copies of one document only if their words agree, and do not remove each
other's words. A null text has no words; a row with a null doc_id removes nothing and loses nothing; documents shorter than a window
are never changed. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import oracles
from driftloom.llm import text as tx
from driftloom.llm.base import bit_set, cut, query, table

WINDOW = 50
BLOCK = WINDOW // 2
BITS = 27
BASE = "row long, doc_id long, text_hash long, n_words long, s1 long, s2 long, kept_sha256 string"


def list_array(doc: np.ndarray, docs: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values by document (`doc` in order)."""
    offsets = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def doc_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def read_blocks(texts: DataFrame) -> DataFrame:
    """Each document's number of words, the hash of its word sequence, the digest of its words, and its reference blocks."""

    def blocks(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.BLANKS, lower=False)
            h = tx.hashes(w)
            counts = w.counts()
            n = len(counts)
            # the sequence as sums over position-dependent mixes: equal for equal sequences, one pass for all documents
            place = (np.arange(len(h)) - np.repeat(w.first[:-1], counts)).astype(np.uint64)
            sums = []
            for salt in (tx.GRAM, tx.SECOND):
                total = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(tx.mixed(h + tx.mixed(place + salt)), out=total[1:])
                sums.append((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
            text, begin = tx.joined(w)
            digests = [hashlib.sha256(text[a:b].data).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            number = np.where(counts >= WINDOW, counts // BLOCK, 0)
            place = tx.ragged(np.zeros(n, dtype=np.int64), number) * BLOCK
            doc = np.repeat(np.arange(n), number)
            block = tx.rolling(h, BLOCK)[w.first[doc] + place].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column("doc_id"), batch.column("text_hash"), pa.array(counts.astype(np.int64)), *map(pa.array, sums),
                 pa.array(digests, pa.string()), list_array(doc, n, block, pa.int64())],
                names=["row", "doc_id", "text_hash", "n_words", "s1", "s2", "kept_sha256", "blocks"])
            row += n

    return texts.mapInArrow(blocks, BASE + ", blocks array<long>")


def probes(texts: DataFrame, shared) -> DataFrame:
    """doc_id and hash of every rolling window that may be a reference block of the shared bit set."""

    def probe(batches):
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.BLANKS, lower=False)
            counts = w.counts()
            h = tx.hashes(w)
            runs = tx.rolling(h, BLOCK)
            if not len(runs):
                continue
            place = (np.arange(len(h)) - np.repeat(w.first[:-1], counts))[:len(runs)]
            # a document's own blocks are known already
            at = np.flatnonzero(tx.inside_document(w.first, BLOCK, len(h)) & (place % BLOCK != 0))
            at = at[tx.in_bits(shared.value, runs[at])]
            doc = doc_of(w.first, at)
            long = counts[doc] >= WINDOW
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[long])), pa.array(runs[at[long]].view(np.int64))],
                                             names=["doc_id", "h"])

    return texts.select("doc_id", "text").where("doc_id is not null").mapInArrow(probe, "doc_id long, h long")


def near_windows(docs: DataFrame) -> DataFrame:
    """row, place, h1, h2 of every window that holds one of the document's anchors (column `anchors`: hashes)."""

    def windows(batches):
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.BLANKS, lower=False)
            h = tx.hashes(w)
            runs = tx.rolling(h, BLOCK).view(np.int64)
            whole = tx.inside_document(w.first, WINDOW, len(h))
            lists = batch.column("anchors")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            marked = np.zeros(len(h) + 1, dtype=np.int64)
            for i in range(batch.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b - a < WINDOW:
                    continue
                at = a + np.flatnonzero(np.isin(runs[a:b - BLOCK + 1], values[offsets[i]:offsets[i + 1]]))
                # windows from at - BLOCK to at hold the anchor
                np.add.at(marked, np.maximum(at - (WINDOW - BLOCK), a), 1)
                np.add.at(marked, np.minimum(at + 1, b), -1)
            starts = np.flatnonzero(whole & (np.cumsum(marked)[:len(whole)] > 0))
            h1, h2 = tx.two_hashes(h, WINDOW)
            doc = doc_of(w.first, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc)), batch.column("doc_id").take(pa.array(doc)),
                 pa.array((starts - w.first[doc]).astype(np.int32)), pa.array(h1[starts]), pa.array(h2[starts])],
                names=["row", "doc_id", "place", "h1", "h2"])

    return docs.mapInArrow(windows, "row long, doc_id long, place int, h1 long, h2 long")


def kept_text(docs: DataFrame) -> DataFrame:
    """row, n_removed and the kept words (joined by one space) of documents with removed windows (column `places`)."""

    def keep(batches):
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.BLANKS, lower=False)
            lists = batch.column("places")
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), counts)
            at = w.first[doc] + lists.values.to_numpy()[lists.offsets.to_numpy()[0]:lists.offsets.to_numpy()[-1]]
            marked = np.zeros(len(w.starts) + 1, dtype=np.int64)
            np.add.at(marked, at, 1)
            np.add.at(marked, at + WINDOW, -1)
            kept = np.cumsum(marked)[:-1] == 0
            text, begin = tx.joined(w, kept)
            left = np.add.reduceat(np.append(kept, False), w.first[:-1]) * (w.counts() > 0) if len(kept) else np.zeros(batch.num_rows)
            texts = [text[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array((w.counts() - left).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["row", "n_removed", "kept_text"])

    return docs.mapInArrow(keep, "row long, n_removed long, kept_text string")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_sha256 for each row; `kept_text` where some but not all words go (else null)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    read = cut(read_blocks(texts), "blocks")
    known = F.col("doc_id").isNotNull()
    bits = bit_set(read.where(known).select(F.explode("blocks").alias("h")), "h", BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** BITS bits, whatever the corpus
    alike = ["n_words", "s1", "s2"]
    first = (read.where(known & (F.col("n_words") >= WINDOW)).groupBy(*alike).agg(F.min(F.struct("doc_id", "row")).alias("x"))
             .select(*alike, F.col("x.doc_id").alias("first_id"), F.col("x.row").alias("first_row")))
    # `first_row` stands for all rows with its id and words; rows of later ids with these words are copies
    base = cut(read.join(first, alike, "left").drop("s1", "s2"), "sequences")
    copied = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    stands = base.where("first_row = row")
    blocks = stands.select("doc_id", F.explode("blocks").alias("h"), F.lit(1).alias("block"))
    found = probes(texts, shared).join(base.where(copied).select("doc_id").distinct(), "doc_id", "left_anti")
    # a hash is an anchor if two documents have it, one of them as a block
    met = cut(blocks.union(found.withColumn("block", F.lit(0)).select("doc_id", "h", "block")), "anchor-hashes")
    shared.destroy()
    anchors = (met.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.max("block").alias("block"))
               .where("x < y and block = 1").select("h"))
    by_doc = met.join(anchors, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))
    wanted = stands.select("doc_id", "text_hash", "row").join(by_doc, "doc_id")
    anchored = cut(texts.join(wanted, ["doc_id", "text_hash"]).select("row", "doc_id", "text", "anchors"), "anchored-texts")
    windows = cut(near_windows(anchored), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    gone = windows.join(least.select("h1", "h2", "least"), ["h1", "h2"]).where("least < doc_id")
    places = gone.groupBy("row").agg(F.collect_list("place").alias("places"))
    changed = kept_text(anchored.select("row", "text").join(places, "row")).dropDuplicates(["row"])
    changed = changed.select(F.col("row").alias("first_row"), "n_removed", "kept_text")
    out = base.select("doc_id", "text_hash", "n_words", "kept_sha256", copied.alias("copied"),
                      F.when(~copied, F.col("first_row")).alias("first_row")).join(changed, "first_row", "left")
    return out.select(
        "doc_id", "text_hash", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).when(F.col("kept_text").isNull(), F.col("kept_sha256"))
        .otherwise(F.sha2("kept_text", 256)).alias("kept_sha256"),
        F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


@query("op5_substring_dedup", oracles.SUBSTRINGS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
