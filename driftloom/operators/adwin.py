"""ADWIN on a 0/1 error sequence (Bifet and Gavalda, 2007), as an ordered fold.

The window is an exponential histogram of buckets, so its state is a few hundred numbers for
any stream length. Errors are packed 32 to a row before the shuffle: one machine word per
check interval instead of one row per prediction.

Between two cuts the buckets follow from the number of rows alone: what a level has merged away is
a closed form of what it received. So `Windowed` has the bucket borders of many tests at once, their
sums as differences of prefix sums, and decides all tests up to the next cut in a few vector
operations; only cuts are sequential. `Adwin` takes one value at a time, for learners that
react to each row; both give the same cuts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.fold import ordered_fold

# Fixed values of the algorithm: buckets per level, rows between cut tests, smallest window
# and smallest sub-window that may be tested.
MAX_BUCKETS = 5
CLOCK = 32
GRACE_PERIOD = 10
MIN_SUBWINDOW = 5


class Adwin:
    """Adaptive window over 0/1 values; `update` is True when a cut follows a rise."""

    def __init__(self, delta: float = 0.01, clock: int = CLOCK):
        self.delta, self.clock = delta, clock
        self.levels: list[list[float]] = [[]]  # per level: bucket sums, oldest first
        self.width = 0
        self.total = 0.0
        self.seen = 0

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0

    def update(self, value: int) -> bool:
        before = self.mean
        self._insert(value)
        self.seen += 1
        if self.seen % self.clock or self.width <= GRACE_PERIOD:
            return False
        shrunk = False
        while self._has_cut():
            self._drop_oldest()
            shrunk = True
        return shrunk and self.mean > before

    def _insert(self, value: int) -> None:
        self.levels[0].append(float(value))
        self.width += 1
        self.total += value
        level = 0
        while len(self.levels[level]) > MAX_BUCKETS:
            if level + 1 == len(self.levels):
                self.levels.append([])
            first, second = self.levels[level][:2]
            del self.levels[level][:2]
            self.levels[level + 1].append(first + second)
            level += 1

    def _drop_oldest(self) -> None:
        top = len(self.levels) - 1
        while not self.levels[top]:
            top -= 1
        self.total -= self.levels[top].pop(0)
        self.width -= 1 << top
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()

    def _has_cut(self) -> bool:
        """Do the means of some older and newer part differ significantly?"""
        n, total = self.width, self.total
        mean = total / n
        variance = mean * (1 - mean)
        log_term = math.log(2 * math.log(n) / self.delta) if n > 1 else 0.0
        n_old, sum_old = 0, 0.0
        for level in range(len(self.levels) - 1, -1, -1):
            for bucket in self.levels[level]:
                n_old += 1 << level
                sum_old += bucket
                n_new = n - n_old
                if n_new < MIN_SUBWINDOW:
                    return False
                if n_old < MIN_SUBWINDOW:
                    continue
                inverse = 1 / (n_old - MIN_SUBWINDOW + 1) + 1 / (n_new - MIN_SUBWINDOW + 1)
                bound = math.sqrt(2 * inverse * variance * log_term) + 2 / 3 * inverse * log_term
                if abs(sum_old / n_old - (total - sum_old) / n_new) > bound:
                    return True
        return False

    def dump(self) -> dict:
        return {"levels": self.levels, "width": self.width, "total": self.total, "seen": self.seen}

    def load(self, state: dict) -> "Adwin":
        self.levels = [list(level) for level in state["levels"]]
        self.width, self.total, self.seen = state["width"], state["total"], state["seen"]
        return self


class Windowed:
    """The same window over whole runs of values; `feed` gives the rises in them."""

    #: Tests decided at once after a cut; twice as many with each run of tests without one.
    TESTS = 64

    def __init__(self, delta: float = 0.01, clock: int = CLOCK):
        self.delta, self.clock = delta, clock
        self.counts = np.zeros(1, dtype=np.int64)  # buckets per level at the last value fed
        self.seen = 0
        # prefix sums at the bucket borders of the values that are gone, oldest first
        self.borders, self.sums = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def grown(self, counts: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Buckets per level after each of `more` further values: a level that would hold more than MAX_BUCKETS merges two."""
        out, arrived, level = [], more.astype(np.int64), 0
        while level < len(counts) or arrived.any():
            held = arrived + (counts[level] if level < len(counts) else 0)
            merged = np.maximum(0, (held - (MAX_BUCKETS - 1)) // 2)
            out.append(held - 2 * merged)
            arrived, level = merged, level + 1
        return np.stack(out, axis=1) if out else np.zeros((len(more), 1), dtype=np.int64)

    def newer(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of counts the values newer than each bucket border, 0 where there is none; and the widths."""
        size = np.int64(1) << np.arange(counts.shape[1])
        below = np.cumsum(counts * size, axis=1) - counts * size
        place = np.arange(1, MAX_BUCKETS + 1)
        count = np.where(place <= counts[:, :, None], below[:, :, None] + place * size[:, None], 0)
        return count.reshape(len(counts), -1), (counts * size).sum(axis=1)

    def cuts(self, at: np.ndarray, counts: np.ndarray, prefix) -> np.ndarray:
        """Whether some border parts each window (`counts`, ending at `at`) significantly."""
        count, width = self.newer(counts)
        n = width.astype(np.float64)[:, None]
        old = width[:, None] - count
        fine = (count >= MIN_SUBWINDOW) & (old >= MIN_SUBWINDOW)
        end, begin = prefix(at), prefix(at - width)
        total = (end - begin).astype(np.float64)[:, None]
        inside = prefix(np.where(fine, at[:, None] - count, at[:, None]))
        sum_old = np.where(fine, inside - begin[:, None], 0).astype(np.float64)
        n_new, n_old = np.where(fine, count, MIN_SUBWINDOW).astype(np.float64), np.where(fine, old, MIN_SUBWINDOW).astype(np.float64)
        mean = total / np.maximum(n, 1)
        term = np.log(2 * np.log(np.maximum(n, 2)) / self.delta)
        inverse = 1 / (n_old - MIN_SUBWINDOW + 1) + 1 / (n_new - MIN_SUBWINDOW + 1)
        bound = np.sqrt(2 * inverse * (mean * (1 - mean)) * term) + 2 / 3 * inverse * term
        return (fine & (np.abs(sum_old / n_old - (total - sum_old) / n_new) > bound)).any(axis=1) & (width > 0)

    def feed(self, values: np.ndarray) -> list[tuple[int, int, float]]:
        """(place in `values`, width, mean) of each rise."""
        start = self.seen
        summed = self.sums[-1] + np.concatenate([[0], np.cumsum(values, dtype=np.int64)])

        def prefix(at: np.ndarray) -> np.ndarray:
            gone = self.sums[np.searchsorted(self.borders, np.minimum(at, start))]
            return np.where(at >= start, summed[np.maximum(at - start, 0)], gone)

        found, base, counts, last, many = [], start, self.counts, start + len(values), self.TESTS
        test = (start // self.clock + 1) * self.clock
        while test <= last:
            at = np.arange(test, min(last, test + (many - 1) * self.clock) + 1, self.clock)
            states = self.grown(counts, at - base)
            wide = (states << np.arange(states.shape[1])).sum(axis=1) > GRACE_PERIOD
            hits = np.flatnonzero(self.cuts(at, states, prefix) & wide)
            k = hits[0] if len(hits) else len(at) - 1
            base, counts, test, many = at[k], states[k], at[k] + self.clock, many * 2
            if not len(hits):
                continue
            many = self.TESTS
            here = np.array([base])
            width = int((counts << np.arange(len(counts))).sum())
            before = float(prefix(here - 1)[0] - prefix(here - width)[0]) / max(width - 1, 1)
            while self.cuts(here, counts[None, :], prefix)[0]:
                counts[np.flatnonzero(counts)[-1]] -= 1
            width = int((counts << np.arange(len(counts))).sum())
            mean = float(prefix(here)[0] - prefix(here - width)[0]) / max(width, 1)
            if mean > before:
                found.append((int(base - start) - 1, width, mean))
        self.counts, self.seen = self.grown(counts, np.array([last - base]))[0], last
        count, width = self.newer(self.counts[None, :])
        borders = np.unique(np.concatenate([last - count[count > 0], [last, last - width[0]]]))
        self.borders, self.sums = borders, prefix(borders)
        return found


def pack_errors(predictions: DataFrame, keys: list[str], first_row: int = 0) -> DataFrame:
    """(keys, word, first, size, bits): 32 consecutive errors per row, combined map-side."""
    late = predictions.where(F.col("idx") >= first_row)
    err = (F.col("pred") != F.col("label")).cast("long")
    return (
        late.withColumn("word", F.floor(F.col("idx") / 32).cast("long"))
        .groupBy(*keys, "word")
        .agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("size"),
             F.sum(F.expr("shiftleft(1L, cast(idx % 32 as int))") * err).alias("bits"))
    )


def unpack(first: int, size: int, bits: int) -> list[int]:
    """Errors of rows first..first+size-1 from one packed row."""
    return [(bits >> ((first + j) % 32)) & 1 for j in range(size)]


def unpack_all(first: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors of all packed rows, and the rows they belong to."""
    ends = np.cumsum(size)
    idx = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
    return (np.repeat(bits, size) >> (idx % 32)) & 1, idx


def error_rises(
    predictions: DataFrame, keys: list[str], key_schema: str,
    delta: float = 0.01, warmup: int = 1000,
) -> DataFrame:
    """Rows at which the error rate rose significantly, with window width and error rate.

    The first `warmup` rows are not shown to the detector: a young model errs wildly.
    """
    packed = pack_errors(predictions, keys, warmup)

    def start():
        window = Windowed(delta)

        def step(batch: pd.DataFrame) -> pd.DataFrame:
            if batch.empty:
                return pd.DataFrame([], columns=[*keys, "idx", "width", "error_rate"])
            values, idx = unpack_all(*(batch[c].to_numpy(np.int64) for c in ("first", "size", "bits")))
            key = [batch[k].iloc[0] for k in keys]
            found = [(*key, int(idx[i]), width, round(mean, 4)) for i, width, mean in window.feed(values)]
            return pd.DataFrame(found, columns=[*keys, "idx", "width", "error_rate"])

        return step

    return ordered_fold(packed, keys, ["word"], start,
                        f"{key_schema}, idx long, width long, error_rate double")
