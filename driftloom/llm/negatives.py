"""Hard negatives of anchor vectors by segment summaries.

For every vector the mean and the deviation (norm about the mean) of each of its segments are known, at LEVELS: few long
segments first, then more and shorter ones. As x . y over a segment of m numbers is m * mean(x) * mean(y) plus a rest of at
most deviation(x) * deviation(y), the summaries bound every score from both sides. Rows that a coarse level leaves open are
bounded again on finer ones, and what is open after the last is scored exactly, in integers.

The anchors are a stated set (a share of all rows) and meet all rows in blocks: anchors and rows are dealt into groups of
about ANCHORS and ROWS by hash, a task takes one group of each, and hands back few rows for each anchor: its best rows of
the same label (first pass), or for each of its positives the best rows of other labels within the wanted share of the
positive's score (second pass). The best of all tasks are then found by a window over these few.

Components become floor(SCALE * x) with x as double. A label of -1 or below moves like any other, by the remainder with its
sign. Null labels, null ids, null vectors and those with null or non-finite components take no part; empty vectors score 0
with each other, and vectors of different length are never compared. Equal rows are one row; rows of equal id but other
vector or label are different rows, each an anchor of its own, and an anchor's other rows include those. Scores are exact
also beyond double precision; one beyond 64 bits is written as the greatest or least long. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import oracles
from driftloom.llm.base import cut, query, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows and anchors of one task, about; numbers of segments by level.
ROWS, ANCHORS, LEVELS = 16_384, 8_192, (4, 16)
#: Anchors bounded at once, and the share of open pairs up to which these are scored one by one.
STEP, FEW = 128, 0.1
LONG = np.iinfo(np.int64)
KEY = ["anchor", "anchor_id"]


def usable(vectors: DataFrame) -> DataFrame:
    """row (a hash of the whole row), id, label and v (array<double>), of distinct rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("id is not null and label is not null and v is not null").where(~bad)
    return rows.withColumn("row", F.xxhash64("id", "label", "v")).dropDuplicates(["row", "id", "label"])


class Summed:
    """Vectors of one length in integers, with the bounds' factors at each level."""

    def __init__(self, x: np.ndarray, exact: bool):
        self.x, self.exact, self.size = x, exact, x.shape[1]
        self.levels = []
        wide = x.astype(np.float64)
        for level in sorted({max(1, min(level, self.size)) for level in LEVELS}) if self.size else []:
            edges = np.linspace(0, self.size, level + 1).astype(np.int64)
            m = np.diff(edges).astype(np.float64)
            mean = np.add.reduceat(wide, edges[:-1], axis=1) / m
            rest = wide - np.repeat(mean, np.diff(edges), axis=1)
            spread = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))
            self.levels.append((mean * np.sqrt(m), spread))

    def scores(self, other: "Summed", i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of rows i of self with rows j of other, as a matrix."""
        return self.x[i] @ other.x[j].T

    def pairs(self, other: "Summed", i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.x[i] * other.x[j]).sum(axis=1)


def summed(anchors: np.ndarray, rows: np.ndarray) -> tuple[Summed, Summed]:
    """Both sides in a type whose products and sums are exact: doubles below 2 ** 53, Python's integers beyond."""
    most = max([1.0, *(float(np.abs(x).max()) for x in (anchors, rows) if x.size)])
    exact = most * most * max(1, rows.shape[1]) < 2.0 ** 53
    if not exact:
        whole = lambda x: np.array([[int(n) for n in r] for r in x], dtype=object).reshape(x.shape)
        anchors, rows = whole(anchors), whole(rows)
    return Summed(anchors, exact), Summed(rows, exact)


def at_most(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of values, or minus infinity if there are fewer."""
    if values.shape[1] <= k:
        return values.min(axis=1, initial=np.inf) if values.shape[1] == k else np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def narrowed(a: Summed, rows: Summed, i: np.ndarray, open_pairs: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in i, row) that the summaries leave open; rule(lower, upper, open) says which stay after each level."""
    j = np.arange(open_pairs.shape[1])
    for (mean_a, spread_a), (mean_r, spread_r) in zip(a.levels, rows.levels):
        some = open_pairs.any(axis=0)
        if not some.all():
            j, open_pairs = j[some], open_pairs[:, some]
        middle, rest = mean_a[i] @ mean_r[j].T, spread_a[i] @ spread_r[j].T
        # room for the rounding of the bounds themselves
        rest += 1.0 + 1e-9 * (np.abs(middle) + rest)
        open_pairs = rule(middle - rest, middle + rest, open_pairs)
    p, q = np.nonzero(open_pairs)
    return p, j[q]


def exactly(a: Summed, rows: Summed, i: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the open pairs: by one product if many are open, else pair by pair."""
    used, at = np.unique(q, return_inverse=True)
    if a.exact and len(p) > FEW * len(i) * max(1, len(used)):
        return a.scores(rows, i, used)[p, at]
    parts = [a.pairs(rows, i[p[s:s + 100_000]], q[s:s + 100_000]) for s in range(0, len(p), 100_000)]
    return np.concatenate(parts) if parts else np.empty(0)


def first_of(p: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each p by falling score; equal scores stay in order."""
    if score.dtype == object:
        order = np.array(sorted(range(len(p)), key=lambda t: (p[t], -score[t], t)), dtype=np.int64)
    else:
        order = np.lexsort((np.arange(len(p)), -score, p))
    group = p[order]
    begins = np.searchsorted(group, group)
    return order[np.arange(len(order)) - begins < k]


def whole_numbers(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array([min(max(int(s), LONG.min), LONG.max) for s in score], dtype=np.int64)
    return score.astype(np.int64)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack(vectors.to_list()).astype(np.float64) * SCALE) if len(vectors) else np.empty((0, 0))


def of_one_length(rows: pd.DataFrame, anchors: pd.DataFrame):
    """The two sides for each vector length that both have, rows in order of id."""
    rows = rows.assign(size=rows["v"].map(len)).sort_values(["id", "row"], kind="stable")
    anchors = anchors.assign(size=anchors["v"].map(len))
    for size, some in anchors.groupby("size"):
        others = rows[rows["size"] == size]
        if len(others):
            a, r = summed(matrix(some["v"]), matrix(others["v"]))
            yield some, others, a, r


def best_same(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each anchor its first k other rows of the same label, among these."""
    out = []
    for some, others, a, r in of_one_length(rows, anchors):
        ids, marks, labels = others["id"].to_numpy(), others["row"].to_numpy(), others["label"].to_numpy()
        for label, group in some.reset_index(drop=True).groupby("label"):
            mine = np.flatnonzero(labels == label)
            if not len(mine):
                continue
            part = Summed(r.x[mine], r.exact)
            for s in range(0, len(group), STEP):
                i = group.index.to_numpy()[s:s + STEP]
                own = some["anchor"].to_numpy()[i]
                open_pairs = marks[mine][None, :] != own[:, None]

                def rule(low, high, still):
                    # what cannot reach the k-th best lower bound is out
                    return still & (high >= at_most(np.where(still, low, -np.inf), k)[:, None])

                p, q = narrowed(a, part, i, open_pairs, rule)
                score = exactly(a, part, i, p, q)
                best = first_of(p, score, k)
                out.append(pd.DataFrame({"anchor": own[p[best]], "anchor_id": some["anchor_id"].to_numpy()[i][p[best]], "row": marks[mine][q[best]],
                                         "id": ids[mine][q[best]], "score": whole_numbers(score[best])}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor", "anchor_id", "row", "id", "score")})


def best_other(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each anchor and positive the first k rows of other labels with a score in the wanted share of the positive's."""
    out = []
    for some, others, a, r in of_one_length(rows, anchors):
        ids, marks, labels = others["id"].to_numpy(), others["row"].to_numpy(), others["label"].to_numpy()
        held = some["scores"].to_numpy()
        most = max(len(s) for s in held)
        wanted = np.array([[int(s[t]) if t < len(s) else 0 for t in range(most)] for s in held], dtype=object)
        there = np.array([[t < len(s) for t in range(most)] for s in held])
        floor = np.where(there, (wanted * LOW / 100).astype(np.float64), np.inf)
        ceiling = np.where(there, (wanted * HIGH / 100).astype(np.float64), -np.inf)
        slack = 1.0 + 1e-9 * np.abs(np.where(there, floor, 0.0))
        for s in range(0, len(some), STEP):
            i = np.arange(s, min(s + STEP, len(some)))
            open_pairs = labels[None, :] != some["label"].to_numpy()[i][:, None]

            def rule(low, high, still, i=i):
                left = np.zeros_like(still)
                for t in range(most):
                    down, up, room = floor[i, t][:, None], ceiling[i, t][:, None], slack[i, t][:, None]
                    maybe = still & (high >= down - room) & (low <= up + room)
                    # rows that are within for certain bar those that cannot reach the k-th best of them
                    sure = np.where(maybe & (low >= down + room) & (high <= up - room), low, -np.inf)
                    left |= maybe & (high >= at_most(sure, k)[:, None])
                return left

            p, q = narrowed(a, r, i, open_pairs, rule)
            score = exactly(a, r, i, p, q)
            whole = whole_numbers(score) if a.exact else score
            for t in range(most):
                target = wanted[i, t][p] if not a.exact else wanted[i, t].astype(np.int64)[p]
                fits = np.flatnonzero(there[i, t][p] & (whole * 100 >= target * LOW) & (whole * 100 <= target * HIGH))
                best = fits[first_of(p[fits], whole[fits], k)]
                at = i[p[best]]
                out.append(pd.DataFrame({"anchor": some["anchor"].to_numpy()[at], "anchor_id": some["anchor_id"].to_numpy()[at], "positive": np.full(len(best), t),
                                         "row": marks[q[best]], "id": ids[q[best]], "score": whole_numbers(whole[best])}))
    names = ("anchor", "anchor_id", "positive", "row", "id", "score")
    return pd.concat(out).astype("int64") if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})


def in_blocks(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], best, schema: str) -> DataFrame:
    """best(rows, anchors) for every group of rows with every group of anchors."""
    by_row, by_anchor = groups
    left = rows.withColumn("r", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(by_row)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(by_anchor - 1))))
    right = anchors.withColumn("a", F.pmod(F.xxhash64("anchor", F.lit(2)), F.lit(by_anchor)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(by_row - 1))))

    def task(x: pa.Table, y: pa.Table) -> pa.Table:
        found = best(x.to_pandas(), y.to_pandas())
        return pa.Table.from_pandas(found, preserve_index=False)

    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(task, schema)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (id, label, v)."""
    rows = cut(usable(vectors).select("row", "id", "label", "v"), "negative-rows")
    anchors = rows.where(is_anchor).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v")
    n, m = rows.count(), anchors.count()
    groups = (max(1, math.ceil(n / ROWS)), max(1, math.ceil(m / ANCHORS)))
    same = in_blocks(rows, anchors, groups, lambda x, y: best_same(x, y, positives), "anchor long, anchor_id long, row long, id long, score long")
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id", "row")
    same = same.withColumn("positive", F.row_number().over(order)).where(F.col("positive") <= positives).withColumn("positive", F.col("positive") - 1)
    same = cut(same, "positives")
    listed = same.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("positive", "score")))["score"].alias("scores"))  # `positives` at most
    asked = cut(anchors.join(listed, KEY), "anchors")
    found = in_blocks(rows, asked, groups, lambda x, y: best_other(x, y, negatives), "anchor long, anchor_id long, positive long, row long, id long, score long")
    order = Window.partitionBy(*KEY, "positive").orderBy(F.desc("score"), "id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    chosen = same.select(*KEY, F.col("positive").cast("long").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(found, [*KEY, "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@query("op12_hard_negatives", oracles.NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("v"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
