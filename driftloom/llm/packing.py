"""Best-fit packing of token pieces into sequences of a fixed length, by bin completion.

A piece only matters by its length, and there are fewer lengths than the sequence is long. So the plan is made over the
counts of each length (bounded by the sequence length, whatever the corpus): around the longest length left, the
undominated fillings of the room beside it are enumerated, best fit first. Best fit decreasing is the first incumbent, so
no plan has more sequences than it; fillings are tried while the waste that they imply leaves room for fewer sequences. A
filling is used as often as the counts allow. The search ends early: FILLINGS fillings around a piece, NODES steps and the
last 200 open branches; beyond them the incumbent stands, and a packing with fewer sequences may exist. The plan is a short
list of slots; the pieces get ranks within their length by Spark, in counted buckets, and look their slot up. Pieces of equal
length are alike; which of them stands where follows from their row numbers. Very long texts are whole, in as many pieces.

Null text is an empty document (one piece with the end id only). Documents of equal ids keep all their rows; a null
doc_id is kept as it is. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import text as tx
from driftloom.llm.base import cut, query, table
from driftloom.llm.tokens import BATCH, Encoder

PIECES = "row long, doc_id long, piece int, start long, length int, ids_crc32 long"
#: Fillings considered around one longest piece, and steps of the search in all.
FILLINGS, NODES = 3, 20_000
BUCKETS = 64


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `size` tokens; only longer ones are cut. `with_ids` adds the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def encode(batches):
        from pyspark import TaskContext

        encoder, row = Encoder.of(tokenizer), TaskContext.get().partitionId() << 40
        for batch in tx.parts(batches, limit=BATCH):
            ids, first = encoder.encode(batch.column("text"), end)
            length = np.diff(first)
            n = -(-length // size)
            doc = np.repeat(np.arange(len(n)), n)
            piece = tx.ragged(np.zeros(len(n), dtype=np.int64), n)
            start = piece * size
            count = np.minimum(size, length[doc] - start)
            at = first[doc] + start
            data = ids.astype("<u4")
            sums = [zlib.crc32(data[a:b].data) for a, b in zip(at.tolist(), (at + count).tolist())]
            columns = [pa.array(row + np.arange(len(doc))), batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                       pa.array(start), pa.array(count.astype(np.int32)), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, first[-1]).astype(np.int32)), pa.array(ids)))
            row += len(doc)
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, schema)


@dataclass
class Plan:
    """Fillings (lengths in order) with the number of sequences that use each."""

    used: list[tuple[tuple[int, ...], int]]
    sequences: int
    bound: int


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: lengths above size - k stand alone, and what lies between k and that shares."""
    lengths = sorted(counts)
    best = -(-sum(s * c for s, c in counts.items()) // size)
    for k in [s for s in lengths if s <= size // 2]:
        alone = sum(c for s, c in counts.items() if s > size - k)
        large = [(s, c) for s, c in counts.items() if size // 2 < s <= size - k]
        mid = sum(s * c for s, c in counts.items() if k <= s <= size // 2)
        free = sum((size - s) * c for s, c in large)
        best = max(best, alone + sum(c for _, c in large) + max(0, -(-(mid - free) // size)))
    return best


def fillings(counts: dict[int, int], room: int, most: int, tries: int = 400) -> list[tuple[int, ...]]:
    """Best undominated fillings of `room`, fullest first, longer pieces before more pieces; a bounded look at each depth."""
    found: dict[int, tuple[int, ...]] = {}
    lengths = sorted((s for s, c in counts.items() if c > 0 and s <= room), reverse=True)
    budget = [tries]

    def dive(left: int, at: int, taken: tuple[int, ...]) -> None:
        budget[0] -= 1
        found.setdefault(left, taken)
        if left == 0 or budget[0] <= 0:
            return
        for i in range(at, len(lengths)):
            s = lengths[i]
            if s > left or taken.count(s) >= counts[s]:
                continue
            dive(left - s, i, (*taken, s))
            if 0 in found or budget[0] <= 0:
                return

    # One piece, then exact pairs. Of fillings with equal room left the one with the longest pieces comes first: it
    # dominates those that have shorter ones in its place, and leaves the short pieces for later gaps.
    for s in lengths:
        found.setdefault(room - s, (s,))
        rest = room - s
        if 0 < rest <= s and counts.get(rest, 0) > (rest == s):
            found.setdefault(0, (s, rest))
    if 0 not in found:
        dive(room, 0, ())
    return [found[left] for left in sorted(found)[:most]]


def completed(filling: tuple[int, ...], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """The filling with whatever still fits, longest first."""
    left = room - sum(filling)
    if not left:
        return filling
    spare = {s: counts[s] - filling.count(s) for s in counts}
    out = list(filling)
    for s in sorted((s for s in spare if s <= left and spare[s] > 0), reverse=True):
        n = min(spare[s], left // s)
        out += [s] * n
        left -= n * s
    return tuple(out)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over the counts: fillings with the number of sequences that use each.

    Sequences of equal filling are one group, and equal pieces go into a group together, so the work grows with the
    number of lengths and fillings and not with the number of pieces.
    """
    groups: dict[int, dict[tuple[int, ...], int]] = {}

    def add(filling: tuple[int, ...], times: int) -> None:
        of_room = groups.setdefault(size - sum(filling), {})
        of_room[filling] = of_room.get(filling, 0) + times

    for s in sorted(counts, reverse=True):
        left = counts[s]
        # the smallest room that fits is the best fit; what is left of it after one piece stays the best while it fits
        for room in sorted(r for r in groups if r >= s):
            for filling, times in sorted(groups[room].items(), reverse=True):
                each = room // s
                full, rest = divmod(min(left, times * each), each)
                used = full + (rest > 0)
                if not used:
                    break
                groups[room][filling] -= used
                if full:
                    add(filling + (s,) * each, full)
                if rest:
                    add(filling + (s,) * rest, 1)
                left -= full * each + rest
            groups[room] = {f: c for f, c in groups[room].items() if c}
            if not groups[room]:
                del groups[room]
            if not left:
                break
        full, rest = divmod(left, size // s)
        if full:
            add((s,) * (size // s), full)
        if rest:
            add((s,) * rest, 1)
    return [(filling, times) for of_room in groups.values() for filling, times in of_room.items()]


def plan(counts: dict[int, int], size: int) -> Plan:
    """Bin completion over the counts of each length (all below `size`), from the best-fit packing as first incumbent."""
    bound = lower_bound(counts, size) if counts else 0
    first = best_fit(counts, size)
    best: list = [first, sum(times for _, times in first)]
    nodes = [NODES]
    total = sum(s * c for s, c in counts.items())

    def descend(left: dict[int, int], used: list, sequences: int, waste: int) -> None:
        trail = []
        while True:
            left = {s: c for s, c in left.items() if c}
            if not left:
                if sequences < best[1]:
                    best[0], best[1] = used + trail, sequences
                return
            # waste that a packing in one sequence less than the incumbent can have
            if best[1] <= bound or waste > (best[1] - 1) * size - total or nodes[0] <= 0:
                return
            nodes[0] -= 1
            longest = max(left)
            rest = dict(left)
            rest[longest] -= 1
            choices = list(dict.fromkeys(completed(f, rest, size - longest) for f in fillings(rest, size - longest, FILLINGS))) or [()]
            options = []
            for f in choices:
                whole = (longest, *f)
                times = min(left[s] // whole.count(s) for s in set(whole))
                after = dict(left)
                for s in whole:
                    after[s] -= times
                options.append((whole, times, after))
            for whole, times, after in options[1:]:
                later.append((after, used + trail + [(whole, times)], sequences + times, waste + times * (size - sum(whole))))
            whole, times, left = options[0]
            trail = trail + [(whole, times)]
            sequences += times
            waste += times * (size - sum(whole))

    later: list = []
    descend(dict(counts), [], 0, 0)
    while later and best[1] > bound and nodes[0] > 0:
        descend(*later.pop())
        del later[:-200]
    return Plan(best[0], best[1], bound)


def slots(made: Plan) -> dict[str, np.ndarray]:
    """The plan by length and rank: pieces of `length` with ranks from `rank` on stand `each` in a sequence from `offset` on."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in made.used:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            each = filling.count(s)
            rows.append((s, rank.get(s, 0), sequence, each, offset))
            rank[s] = rank.get(s, 0) + each * times
            offset += each * s
        sequence += times
    rows.sort()
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table_.T))


def pack(cut_pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table, as `pieces` makes them)."""
    spark = cut_pieces.sparkSession
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS))
    by_bucket = cut_pieces.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n")).toPandas()
    # at most size x BUCKETS rows
    by_bucket = by_bucket.sort_values(["length", "bucket"])
    by_bucket["before"] = by_bucket.groupby("length")["n"].cumsum() - by_bucket["n"]
    counts = {int(s): int(c) for s, c in by_bucket[by_bucket["length"] < size].groupby("length")["n"].sum().items()}
    made = plan(counts, size)
    found = slots(made)
    key = found["length"] << 40 | found["rank"]
    fulls = made.sequences
    offsets = spark.createDataFrame(by_bucket[["length", "bucket", "before"]].astype("int64"), "length long, bucket long, before long") \
        if len(by_bucket) else spark.createDataFrame([], "length long, bucket long, before long")
    ranked = (cut_pieces.withColumn("bucket", bucket)
              .withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
              .join(offsets, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))
              .drop("bucket", "place", "before"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            sequence, offset = fulls + rank, np.zeros(len(rank), dtype=np.int64)
            part = np.flatnonzero(length < size)
            if len(part):
                at = np.searchsorted(key, length[part] << 40 | rank[part], side="right") - 1
                local = rank[part] - found["rank"][at]
                each = found["each"][at]
                sequence[part] = found["sequence"][at] + local // each
                offset[part] = found["offset"][at] + local % each * length[part]
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Training sequences from packed pieces with ids: sequence_id, ids, doc_starts (offsets at which a piece begins)."""
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(inner.alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("doc_starts")))


def packed_documents(docs: DataFrame, tokenizer: str, size: int, end: int = 0) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer, end, size), "pieces"), size)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
