"""Benchmark decontamination by winnowing.

Documents and benchmark items are fingerprinted alike: of every `SPAN` consecutive hashes of `GRAM` words the least one is
kept (the right one of equals), so any shared run of GRAM + SPAN - 1 = 13 words has a kept hash in common. The items'
fingerprints become a bit set of fixed size, which documents probe while they are read; around each hit the windows of
13 words that hold it are compared with the items' windows by a join on 128 bits, and what matches is joined to runs.
Items of fewer than 13 words are one window; documents probe every window of those lengths (twelve at most).

A document's rows are kept apart by a row number, so repeated ids keep their own results. Null or empty text has no
words and no hits; null items have no windows; equal items each count; other columns of either table are not read. An
empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import oracles
from driftloom.llm import text as tx
from driftloom.llm.base import bit_set, cut, query, table

WINDOW, GRAM = 13, 8
SPAN = WINDOW - GRAM + 1
BITS = 23
HITS = "row long, doc_id long, n_words long, starts array<int>, lengths array<int>, h1 array<long>, h2 array<long>"


def winnowed(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the kept hashes: the least of each SPAN gram hashes of a document, the right one of equals."""
    grams = tx.rolling(h, GRAM)
    n = len(grams) - SPAN + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    least, at = grams[SPAN - 1:].copy(), np.full(n, SPAN - 1)
    for j in range(SPAN - 2, -1, -1):
        lower = grams[j:j + n] < least
        least[lower], at[lower] = grams[j:j + n][lower], j
    whole = tx.inside_document(first, WINDOW, len(h))
    return np.unique((np.arange(n) + at)[whole])


def item_windows(items: DataFrame) -> DataFrame:
    """item, length, h1, h2 of each window, and the fingerprints (kept hash of long items, the window itself of short ones)."""

    def windows(batches):
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.LETTERS)
            h = tx.hashes(w)
            rows = []
            counts = w.counts()
            kept = winnowed(h, w.first)
            grams = tx.rolling(h, GRAM)
            for n in sorted({WINDOW, *counts[(counts > 0) & (counts < WINDOW)].tolist()}):
                h1, h2 = tx.two_hashes(h, n)
                whole = tx.inside_document(w.first, n, len(h))
                doc = np.repeat(np.arange(len(counts)), counts)[:len(whole)]
                at = np.flatnonzero(whole & (counts[doc] == n if n < WINDOW else counts[doc] >= n))
                rows.append((doc[at], np.full(len(at), n), h1[at], h2[at], h1[at] if n < WINDOW else None))
            doc, length, h1, h2 = (np.concatenate([r[i] for r in rows]) for i in range(4))
            prints = [grams[kept].view(np.int64), *[r[4] for r in rows if r[4] is not None]]
            prints = np.concatenate(prints)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("item").take(pa.array(doc)), pa.nulls(len(prints), pa.string())]),
                 pa.array(np.concatenate([length, np.zeros(len(prints), dtype=np.int64)]).astype(np.int32)),
                 pa.array(np.concatenate([h1, prints])), pa.array(np.concatenate([h2, prints]))],
                names=["item", "length", "h1", "h2"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(windows, "item string, length int, h1 long, h2 long")


def candidates(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """For each document its words and the windows that may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** BITS bits

    def probe(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in tx.parts(batches):
            w = tx.split(batch.column("text"), tx.LETTERS)
            h = tx.hashes(w)
            counts = w.counts()
            found = []
            kept = winnowed(h, w.first)
            if len(kept):
                kept = kept[tx.in_bits(shared.value, tx.rolling(h, GRAM)[kept])]
            starts = np.unique((kept[:, None] - np.arange(SPAN)).ravel())
            starts = starts[(starts >= 0) & (starts + WINDOW <= len(h))]
            found.append((WINDOW, starts))
            for n in short:
                found.append((n, np.flatnonzero(tx.in_bits(shared.value, tx.rolling(h, n)))))
            at, length, h1, h2 = [], [], [], []
            for n, starts in found:
                starts = starts[tx.inside_document(w.first, n, len(h))[starts]] if len(starts) else starts
                if len(starts):
                    a, b = tx.two_hashes(h, n)
                    at.append(starts), length.append(np.full(len(starts), n)), h1.append(a[starts]), h2.append(b[starts])
            empty = np.empty(0, dtype=np.int64)
            at, length, h1, h2 = (np.concatenate([empty, *x]) for x in (at, length, h1, h2))
            doc = np.searchsorted(w.first, at, side="right") - 1
            order = np.argsort(doc, kind="stable")
            offsets = pa.array(np.searchsorted(doc[order], np.arange(len(counts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], kind)) for x, kind in
                     ((at - w.first[doc], pa.int32()), (length, pa.int32()), (h1, pa.int64()), (h2, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(counts.astype(np.int64)), *lists],
                names=["row", "doc_id", "n_words", "starts", "lengths", "h1", "h2"])
            row += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(probe, HITS)


def covered(spans: Column) -> Column:
    """Words in the union of spans (an array of (start, length), in order of start)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a, s):
        end = s["start"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"),
                        (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids whose windows occur, sorted as strings), spans, contaminated."""
    windows = cut(item_windows(benchmark), "item-windows")
    bits = bit_set(windows.where("length = 0"), "h1", BITS)
    short = [r["length"] for r in windows.where(f"length > 0 and length < {WINDOW}").select("length").distinct().collect()]
    probed = cut(candidates(docs, bits, sorted(short)), "probed-documents")
    base = probed.select("row", "doc_id", "n_words")
    near = (probed.where(F.size("starts") > 0)
            .select("row", F.explode(F.arrays_zip("starts", "lengths", "h1", "h2")).alias("x"))
            .select("row", F.col("x.starts").alias("start"), F.col("x.lengths").alias("length"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")))
    keys = ["length", "h1", "h2"]
    real = windows.where("length > 0")
    hits = near.join(real.select(*keys).distinct(), keys, "left_semi")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    pairs = near.select("row", *keys).distinct().join(real.distinct(), keys).where("item is not null").select("row", "item").distinct()
    items = pairs.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = base.join(spans, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * least_percent)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` whose id has no contaminated text; rows without an id stay."""
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_doc_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_doc_id"], "left_anti")


@query("op1_decontamination", oracles.DECONTAMINATION)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
