"""Percentiles by rank: order statistics of groups of any size, without a group in one task or one buffer.

Equal values are one counted row, the counted rows are range-partitioned by (keys, value), and a partition's place in its
group follows from the totals of the partitions before it. A group that holds most rows is spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.session import cut


def quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Mapping[str, float]) -> DataFrame:
    """keys and one column for each name of `shares`: the value at rank share * (n - 1), between two values by proportion.

    NULL values do not count; a group without values has no row.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ordered = cut(values.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranked")
    totals = ordered.groupBy(*keys, "_part").agg(F.sum("_c").alias("_sum"))
    by_key = Window.partitionBy(*keys)
    before = F.sum("_sum").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    places = cut(totals.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(by_key).alias("_n")), "rank-places")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (ordered.withColumn("_upto", F.sum("_c").over(inside))
              .join(places.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_n"),
                    reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))))
    last = F.col("_before") + F.col("_upto")  # ranks from 0 on: this row holds last - _c .. last - 1

    def at(rank):
        return F.max(F.when((last > rank) & (last - F.col("_c") <= rank), F.col("_v")))

    picked = []
    for name, share in shares.items():
        rank = (F.col("_n") - 1) * F.lit(float(share))
        picked += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}"), F.max(rank - F.floor(rank)).alias(f"_w_{name}")]
    found = ranked.groupBy(*keys).agg(*picked)
    between = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in shares]
    return found.select(*keys, *between)


def with_quantiles(summary: DataFrame, df: DataFrame, keys: Sequence[str], shares: Mapping[str, tuple[str, float]]) -> DataFrame:
    """`summary` (one row per group of `df`) with percentiles: name -> (column, share)."""
    for column in dict.fromkeys(c for c, _ in shares.values()):
        found = quantiles(df, keys, column, {n: s for n, (c, s) in shares.items() if c == column})
        renamed = found.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], *found.columns[len(keys):])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate(keys)])
        summary = summary.join(renamed, same, "left").drop(*[f"_q{i}" for i in range(len(keys))])
    return summary
