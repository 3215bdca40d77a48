"""Dense instance index over a time order, without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.session import cut


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Add 0..n-1 in the given order.

    Rows are range-partitioned and sorted in parallel, the position inside a partition is
    read off, and one offset per partition is added. A content hash and a random salt end
    the sort key, so a run of equal keys, even of exact copies, still splits over partitions.
    The range step is written once: sampling may choose other bounds on a second run.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salted = df.withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_salt", F.rand(7))
    key = [*order, "_tie", "_salt"]
    ranged = (
        salted.repartitionByRange(parts, *key)
        .sortWithinPartitions(*key)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
        .withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_tie", "_salt")
    )
    placed = cut(ranged, "ranged")
    sizes = placed.groupBy("_part").count()
    # One row per partition of the range step, so this window and the broadcast stay small.
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("count").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )
