"""Blocked prefix aggregates: running state over one long ordered group without one long task.

A window ordered by `idx` under a key is a single task per key, and a frequent word, or the
stream as a whole, is one huge key. `running` works on (keys, block): a local window inside
each block, one total per block, windows over the few totals, and one join of the carry back
on (keys, block). Row-level work is spread over blocks; only totals meet per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
# Largest exponent used inside one frame of a decayed sum: e^300 is far from overflow, and
# what lies three frames back has aged by e^-600 at least: nothing beside any smoothing term.
FRAME_EXPONENT = 300.0


# Rows of one task, where a plan puts many sorts and aggregates on them: shuffled bytes say little about their memory,
# since equal words and times shrink to a few bytes on the way.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks to spread so many rows over; None leaves it to Spark."""
    if rows <= TASK_ROWS:
        return None
    return max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_of(idx: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(idx / F.lit(block_rows)).cast("long")


def blocks_between(table: DataFrame, first: str, last: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block that the range first..last touches.

    Turns a range join into an equi-join on (stream, block) plus a filter, so no side has to be
    broadcast and no stream is a hot key.
    """
    return table.withColumn("blk", F.explode(F.sequence(
        block_of(F.col(first), block_rows), block_of(F.col(last), block_rows))))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    decayed: Mapping[str, Column] | None = None,
    age: Column | None = None,
) -> DataFrame:
    """Add exclusive running aggregates over `order` within `keys`.

    sums     running sum of earlier rows, 0 before the first
    maxes    running maximum of earlier rows, NULL before the first
    decayed  sum over earlier rows j of term_j * exp(-(age_i - age_j)), where `age` (rate x
             time) does not decrease; terms are summed in frames of the age axis, so exp
             cannot overflow however long the stream is

    The block column must be monotone in the order column. `df` is read twice (rows, totals):
    give it as a table or a narrow step over one.
    """
    sums, maxes, decayed = dict(sums or {}), dict(maxes or {}), dict(decayed or {})
    kept = df.columns
    part = [*keys, block]
    if decayed:
        df = df.withColumn("_age", age)
        df = df.withColumn("_frame", F.floor(F.col("_age") / FRAME_EXPONENT).cast("long"))
        df = df.withColumn("_grow", F.exp(F.col("_age") - F.col("_frame") * FRAME_EXPONENT))
        decayed = {n: c * F.col("_grow") for n, c in decayed.items()}
        part = [*keys, "_frame", block]

    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    added = {**sums, **decayed}
    local = df.select(
        "*",
        *[F.sum(c).over(before).alias(f"_in_{n}") for n, c in added.items()],
        *[F.max(c).over(before).alias(f"_in_{n}") for n, c in maxes.items()],
    )
    totals = df.groupBy(*part).agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in added.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in maxes.items()],
    )
    carry = _carry(totals, keys, part, sums, maxes, decayed)

    def plain(n: str) -> Column:
        return F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))

    return local.join(carry, part, "left").select(
        *[F.col(c) for c in kept],
        *[plain(n).alias(n) for n in sums],
        *[F.greatest(f"_in_{n}", f"_carry_{n}").alias(n) for n in maxes],
        *[(plain(n) / F.col("_grow")).alias(n) for n in decayed],
    )


def running_near(
    df: DataFrame,
    keys: Sequence[str],
    near: Sequence[str],
    order: str,
    block: str,
    sums: Mapping[str, Column],
    maxes: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """`running`, for many small groups that are wanted together: the rows are dealt by `near`, some of the keys, and the block.

    What a block inherits comes as one more row before its first, not by a join, so the result lies as it was dealt and
    may be grouped by any columns that include these without another shuffle. `parts` tasks share the rows, where given.
    """
    part = [*keys, block]
    values = {**{n: c for n, c in sums.items()}, **{n: c for n, c in maxes.items()}}
    totals = df.groupBy(*part).agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_max_{n}") for n, c in maxes.items()])
    carry = _carry(totals, keys, part, sums, maxes, {}).dropna(subset=part).select(
        *part, *[F.col(f"_carry_{n}").alias(f"_of_{n}") for n in values], F.lit(False).alias("_own"))
    rows = df.select("*", *[c.alias(f"_of_{n}") for n, c in values.items()], F.lit(True).alias("_own"))
    both = rows.unionByName(carry, allowMissingColumns=True)
    dealt = both.repartition(parts, *near, block) if parts else both.repartition(*near, block)
    before = Window.partitionBy(*part).orderBy("_own", order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.select(
        "_own", *df.columns, *[F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"_of_{n}").over(before).alias(n) for n in maxes])
    return found.where("_own").drop("_own")


def _carry(totals, keys, part, sums, maxes, decayed) -> DataFrame:
    """What each block inherits from all earlier blocks of its key."""
    by_key = Window.partitionBy(*keys).orderBy(*part[len(keys):])
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in sums]
    columns += [F.max(f"_max_{n}").over(earlier).alias(f"_carry_{n}") for n in maxes]
    if not decayed:
        return totals.select(*part, *columns)

    in_frame = (
        Window.partitionBy(*keys, "_frame").orderBy(part[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    frames = totals.groupBy(*keys, "_frame").agg(
        *[F.sum(f"_sum_{n}").alias(f"_all_{n}") for n in decayed])
    by_frame = Window.partitionBy(*keys).orderBy("_frame")

    def back(n: str, steps: int) -> Column:
        gap = (F.col("_frame") - F.lag("_frame", steps).over(by_frame)) * FRAME_EXPONENT
        return F.coalesce(F.lag(f"_all_{n}", steps).over(by_frame) * F.exp(-gap), F.lit(0.0))

    inherited = frames.select(
        *keys, "_frame", *[(back(n, 1) + back(n, 2)).alias(f"_old_{n}") for n in decayed])
    columns += [
        (F.coalesce(F.sum(f"_sum_{n}").over(in_frame), F.lit(0.0)) + F.col(f"_old_{n}"))
        .alias(f"_carry_{n}") for n in decayed
    ]
    return totals.join(inherited, [*keys, "_frame"]).select(*part, *columns)
