"""Byte kernels over Arrow text batches: words, word hashes and rolling word windows.

Everything works on whole texts; a batch is only cut between documents, so that the arrays of one step stay small.
Words are told apart by 64-bit hashes of their bytes and windows by one or two 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
GRAM = U64(0xD6E8FEB86659FD93)
SECOND = U64(0xA0761D6478BD642F)
STEP_BYTES = 1 << 20

BLANKS = np.ones(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a batch: byte positions, and the first word of each document (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes of text at most; a longer document is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array, inside: np.ndarray = BLANKS, lower: bool = True) -> Words:
    """Runs of bytes that are `inside`; a run ends with its document."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    mark = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = mark
    starts = np.flatnonzero(mark & (~before[:-1] | edge[:-1]))
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = mark
    ends = np.flatnonzero(mark & (~after[1:] | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, kept for the next step unless a very long word asked for more."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, STEP_BYTES + 1), base, dtype=U64)
        held[0] = 1
        np.cumprod(held, out=held)
        if len(held) <= 4 * STEP_BYTES:
            _powers[int(base)] = held
    return held


INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def hashes(words: Words) -> np.ndarray:
    """One 64-bit hash for each word, equal for equal words."""
    out = np.empty(len(words.starts), dtype=U64)
    i = 0
    while i < len(out):
        base = words.starts[i]
        j = max(i + 1, int(np.searchsorted(words.ends, base + STEP_BYTES, side="right")))
        span = words.data[base:words.ends[j - 1]]
        sums = np.zeros(len(span) + 1, dtype=U64)
        np.cumsum((span.astype(U64) + U64(1)) * powers(BASE, len(span))[:len(span)], out=sums[1:])
        s, e = words.starts[i:j] - base, words.ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * powers(INVERSE, len(span))[s]
        i = j
    return mixed(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for every i, by doubling: log2(k) passes."""
    n, run, length, done, have = len(h), h, 1, None, 0
    if n < k:
        return np.empty(0, dtype=U64)
    while k:
        if k & 1:
            if done is None:
                done, have = run, length
            else:
                m = n - have - length + 1
                done = done[:m] * U64(pow(int(GRAM), length, 1 << 64)) + run[have:have + m]
                have += length
        k >>= 1
        if k:
            m = n - 2 * length + 1
            run = run[:m] * U64(pow(int(GRAM), length, 1 << 64)) + run[length:length + m]
            length *= 2
    return mixed(done)


def two_hashes(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of k words, as two signed columns."""
    return rolling(h, k).view(np.int64), rolling(mixed(h ^ SECOND), k).view(np.int64)


def inside_document(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Marks the starts of windows of k words that lie within one document; total - k + 1 of them."""
    n = max(0, total - k + 1)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + count[i] - 1 for all i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return np.arange(total, dtype=np.int64) + shift


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes, and where each document begins."""
    length = words.ends - words.starts
    doc_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    starts = words.starts
    if keep is not None:
        length, doc_of, starts = length[keep], doc_of[keep], starts[keep]
    last = np.ones(len(doc_of), dtype=bool)
    last[:-1] = doc_of[1:] != doc_of[:-1]
    room = length + ~last
    end = np.cumsum(room)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    out[ragged(end - room, length)] = words.data[ragged(starts, length)]
    begin = np.zeros(len(words.first), dtype=np.int64)
    np.cumsum(np.bincount(doc_of, weights=room, minlength=len(words.first) - 1).astype(np.int64), out=begin[1:])
    return out, begin


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in a bit set of a power-of-two size; see `bit_cells`."""
    size = U64(len(bits) * 64 - 1)
    found = np.ones(len(h), dtype=bool)
    for turn in (U64(0), U64(23)):
        cell = (h >> turn) & size
        found &= (bits[cell >> U64(6)] >> (cell & U64(63))) & U64(1) == 1
    return found
