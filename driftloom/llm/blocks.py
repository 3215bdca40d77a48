"""Word n-grams of a corpus in packed blocks, and the counts that each block needs of the whole corpus.

A block is a bounded run of documents (TOKENS words). It keeps its texts as numbers into its own list of distinct words,
and asks for each distinct n-gram: one packed list of sorted 64-bit keys and local counts for each shard. A shard adds up
the counts of a key over all blocks and answers each block in place. A word or n-gram that is in every document is thus
one entry for each block and shard, never a row for each occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import text as tx

#: Words of a block, about.
TOKENS = 2_000_000
STREAM = "block long, kind int, shard int, payload binary"
END = np.uint64(0x27D4EB2F165667C5)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed buffer, read back by `unpacked` with the same types."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64).tobytes()
    body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return head + np.int64(len(raw)).tobytes() + body


def unpacked(payload: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(payload, dtype=np.int64, count=n, offset=8)
    total = int(np.frombuffer(payload, dtype=np.int64, count=1, offset=8 * (n + 1))[0])
    body = payload[8 * (n + 2):]
    raw = pa.decompress(body, decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(raw[e - s:e], dtype=k) for s, e, k in zip(sizes, ends, kinds)]


def key_bytes(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, byte planes apart: the high bytes compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy().ravel()


def keys_of(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


@dataclass
class Block:
    """Documents of a block: ids, whether each is learned from, word numbers (an end after each text), distinct words."""

    doc_id: np.ndarray
    no_id: np.ndarray
    learned: np.ndarray
    extra: np.ndarray
    first: np.ndarray
    number: np.ndarray
    word: np.ndarray

    def store(self) -> bytes:
        """Words by frequency, numbers as byte planes: that is what compresses best."""
        order = np.argsort(-np.bincount(self.number, minlength=len(self.word)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        planes = rank[self.number].view(np.uint8).reshape(-1, 4).T
        return packed(self.doc_id, self.no_id, self.learned, self.extra, self.first, planes, self.word[order])

    @classmethod
    def load(cls, payload: bytes) -> "Block":
        *columns, planes, word = unpacked(payload, np.int64, np.bool_, np.bool_, np.int64, np.int64, np.uint8, np.uint64)
        order = np.argsort(word)
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        rank = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
        return cls(*columns, place[rank], word[order])

    def weight(self) -> np.ndarray:
        """1 for each token of a learned document."""
        return np.repeat(self.learned, np.diff(self.first))

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(key, back) for each order from 1: distinct sorted keys, and each token's place among them.

        A key of order n is of the n - 1 words before a token and the token; before the first word stands the start.
        """
        tokens = self.word[self.number]
        begins = np.zeros(len(tokens), dtype=bool)
        begins[self.first[:-1]] = True
        out, run = [], tx.mixed(tokens)
        back = self.number.astype(np.int64)
        out.append((self.word, back))
        before, start = tokens, begins
        for n in range(2, order + 1):
            # the word n - 1 places before, or the start
            shifted = np.empty_like(before)
            shifted[1:] = before[:-1]
            shifted[start] = tx.BASE
            before = shifted
            grown = start.copy()
            grown[1:] |= start[:-1]
            start = grown
            run = tx.mixed(run * tx.GRAM + before + np.uint64(n))
            key, back = np.unique(run, return_inverse=True)
            out.append((key, back))
        return out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks from batches of doc_id, learned, extra and text; tokens are lower-cased words and an end after each text."""
    held: list = []
    size = 0

    def close() -> Block:
        ids, learned, extra, counts, h = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4, 5))
        no_id = np.concatenate([x[1] for x in held])
        word, number = np.unique(h, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return Block(ids, no_id, learned, extra, first, number.astype(np.uint32), word)

    for batch in tx.parts(batches):
        w = tx.split(batch.column("text"), tx.BLANKS)
        h = np.insert(tx.hashes(w), w.first[1:], END)
        ids = batch.column("doc_id")
        held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                     batch.column("learned").to_numpy(zero_copy_only=False), batch.column("extra").to_numpy(), w.counts() + 1, h))
        size += len(h)
        if size >= TOKENS:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def write_blocks(docs: DataFrame, sealed: bool = False) -> DataFrame:
    """block and payload (its texts as numbers, and its words).

    With `sealed` the number of a block ends in a checksum of its payload, so what was asked for a block cannot meet another
    one if blocks are built a second time.
    """

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, block in enumerate(blocks_of(batches)):
            payload = block.store()
            at = part << 40 | n << 24 | zlib.crc32(payload) & 0xFFFFFF if sealed else (part << 32) + n
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

    return docs.mapInArrow(build, "block long, payload binary")


def asks(written: DataFrame, order: int, shards: int, bits=None) -> DataFrame:
    """Each block's distinct n-grams (kind n) of a shard, with their counts in its learned texts.

    With `bits` (a broadcast bit set of known n-grams) a block asks for those that pass it only.
    """

    def ask(batches):
        for batch in batches:
            for at, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block = Block.load(payload.as_py())
                weight = block.weight()
                for n, (key, back) in enumerate(block.grams(order), 1):
                    count = np.bincount(back, weights=weight, minlength=len(key)).astype(np.uint32)
                    if bits is not None:
                        passed = tx.in_bits(bits.value, key)
                        key, count = key[passed], count[passed]
                    bounds = shard_bounds(key, shards)
                    full = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
                    payloads = [packed(key_bytes(key[bounds[s]:bounds[s + 1]]), count[bounds[s]:bounds[s + 1]]) for s in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at] * len(full), pa.int64()), pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()),
                         pa.array(payloads, pa.binary())], names=["block", "kind", "shard", "payload"])

    return written.mapInArrow(ask, STREAM)


def shard_bounds(key: np.ndarray, shards: int) -> np.ndarray:
    """Sorted keys by ranges of the hash."""
    edges = (np.arange(1, shards, dtype=np.float64) / shards * 2.0**64).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])


def answers(asked: DataFrame) -> DataFrame:
    """Rows like `asked` whose payload holds the count of each key in all learned texts, and one row of block -1 for each
    (kind, shard): the sum of counts and the number of keys with a count."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked(p, np.uint8, np.uint32) for p in frame["payload"]]
        keys = [keys_of(k) for k, _ in lists]
        every = np.concatenate(keys)
        known, back = np.unique(every, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([c for _, c in lists]), minlength=len(known)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = [packed(total[back[e - len(k):e]]) for k, e in zip(keys, ends)]
        answered = frame[["block", "kind", "shard"]].assign(payload=out)
        sums = pd.DataFrame({"block": [-1], "kind": [frame["kind"].iloc[0]], "shard": [frame["shard"].iloc[0]],
                             "payload": [packed(np.array([total.sum(), (total > 0).sum()], dtype=np.int64))]})
        return pd.concat([answered, sums], ignore_index=True)

    return asked.groupBy("kind", "shard").applyInPandas(answer, STREAM)


def totals(answered: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each order: tokens counted, and distinct keys with a count. One row for each order and shard is read."""
    out: dict[int, tuple[int, int]] = {}
    for r in answered.where("block = -1").select("kind", "payload").collect():
        total, distinct = unpacked(bytes(r["payload"]), np.int64)[0].tolist()
        have = out.get(r["kind"], (0, 0))
        out[r["kind"]] = (have[0] + total, have[1] + distinct)
    return out


def with_answers(written: DataFrame, answered: DataFrame, score: Callable, schema: str, numbers: int = 0) -> DataFrame:
    """Each block with what the shards said of its n-grams, by order and in the order of its keys: one array of counts, or
    as many arrays of `numbers`."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            raise ValueError("answers to a block that is not there")
        counts = {}
        for kind, part in right.sort_values(["kind", "shard"]).groupby("kind"):
            if numbers:
                lists = [unpacked(p, *[np.float32] * numbers) for p in part["payload"]]
                counts[int(kind)] = tuple(np.concatenate(x) for x in zip(*lists))
            else:
                counts[int(kind)] = np.concatenate([unpacked(p, np.int64)[0] for p in part["payload"]])
        return score(Block.load(left["payload"].iloc[0]), counts)

    return written.groupBy("block").cogroup(answered.where("block >= 0").groupBy("block")).applyInPandas(run, schema)


def shards_for(docs: DataFrame) -> int:
    """As many shards as the session has shuffle partitions, and so more for more data."""
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(docs: DataFrame, learned, extra=None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), learned.alias("learned"),
                       (F.lit(0) if extra is None else extra).cast("long").alias("extra"), F.col("text").cast("string").alias("text"))
