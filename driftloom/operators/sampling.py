"""Exact, repeatable sampling without one task per stratum.

Draws are ordered by an MD5 of (seed, id): repeatable on any partitioning and the same in any
SQL engine. Ranks inside a stratum come from blocked counts, so a stratum may be any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.operators.prefix import BLOCK_ROWS, block_of, running

# Relative keep weights per segment; their swings create the prior shifts.
POSITIVE_PATTERN = (1.0, 0.25, 0.8, 0.15, 0.6, 0.3)
NEGATIVE_PATTERN = (0.6, 1.0, 0.5, 1.0, 0.7, 1.0)
SEGMENTS = len(POSITIVE_PATTERN)
BISECTIONS = 100


def draw_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1)."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drawn_ordinal(df: DataFrame, strata: list[str], key: Column, out: str = "ordinal") -> DataFrame:
    """0-based rank of each row in its stratum by draw key, counted in 4,096 key buckets."""
    keyed = df.withColumn("_key", key).withColumn(
        "_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("long"))
    return running(keyed, strata, "_key", "_bucket", sums={out: F.lit(1)}).drop("_key", "_bucket")


def ordinal_by_index(df: DataFrame, strata: list[str], out: str = "ordinal",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based rank of each row in its stratum by idx."""
    keyed = df.withColumn("_bucket", block_of(F.col("idx"), block_rows))
    return running(keyed, strata, "idx", "_bucket", sums={out: F.lit(1)}).drop("_bucket")


def natural_change_point(rows: DataFrame) -> DataFrame:
    """One row: the index after the last positive, and its timestamp where one follows."""
    last = F.max(F.when(F.col("label") == 1, F.col("idx"))) + 1
    point = rows.agg(last.alias("change_idx"))
    return point.join(rows.select(F.col("idx").alias("change_idx"), F.col("ts").alias("change_ts")),
                      "change_idx", "left")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Rows beyond the first of each id."""
    per_id = rows.groupBy("id").count()
    return per_id.agg(F.sum(F.col("count") - 1).alias("duplicates"), F.sum("count").alias("n"))


def usable_rows(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Drop every row of a repeated id, and rows without tokens."""
    repeated = rows.groupBy("id").count().where("count > 1").select("id")
    return rows.where(F.size(tokens) > 0).join(repeated, "id", "left_anti")


def segment_bounds(change_idx: int) -> list[int]:
    """Inner and last bounds of equal segments of rows 0..change_idx-1."""
    return [change_idx * i // SEGMENTS for i in range(1, SEGMENTS + 1)]


def with_segment(rows: DataFrame, change_idx: int) -> DataFrame:
    """Add segment 0..5 of equal parts before change_idx; the tail from there on is segment 6."""
    passed = [(F.col("idx") >= b).cast("int") for b in segment_bounds(change_idx)]
    return rows.withColumn("segment", sum(passed[1:], passed[0]))


def quotas(segmented: DataFrame, targets: dict[int, int]) -> DataFrame:
    """(segment, label, size, quota): rows to keep per stratum, summing to the class target.

    Quotas are proportional to pattern x size with fractions capped at 1; the scale comes from
    a bisection over the six sizes, and the rounding remainder goes to the strata that dropped
    most rows.
    """
    spark = segmented.sparkSession
    patterns = spark.createDataFrame(
        [(s, c, float(p), int(targets[c])) for c, ps in ((1, POSITIVE_PATTERN), (0, NEGATIVE_PATTERN))
         for s, p in enumerate(ps)],
        "segment int, label int, pattern double, target long")
    sizes = segmented.where(f"segment < {SEGMENTS}").groupBy(
        F.col("segment").cast("int").alias("segment"), F.col("label").cast("int").alias("label")
    ).agg(F.count(F.lit(1)).alias("size"))
    strata = patterns.join(sizes, ["segment", "label"], "left").fillna(0, ["size"])
    per_class = strata.groupBy("label", "target").agg(
        F.array_sort(F.collect_list(F.struct("segment", "pattern", "size"))).alias("strata"),
        F.min("pattern").alias("least"))

    def kept(scale: Column) -> Column:
        return F.aggregate("strata", F.lit(0.0), lambda acc, s: acc + F.least(
            F.lit(1.0), scale * s["pattern"]) * s["size"])

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        short = kept(mid) < F.col("target")
        return F.struct(
            F.when(short, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(short, acc["hi"]).otherwise(mid).alias("hi"),
            mid.alias("mid"))

    start = F.struct(F.lit(0.0).alias("lo"), (1.0 / F.col("least")).alias("hi"), F.lit(0.0).alias("mid"))
    scaled = per_class.withColumn(
        "scale", F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)["mid"])
    counted = scaled.select("label", "target", "scale", F.inline("strata")).withColumn(
        "base", F.floor(F.least(F.lit(1.0), F.col("scale") * F.col("pattern")) * F.col("size")).cast("long"))
    of_class = Window.partitionBy("label")
    rank = F.row_number().over(of_class.orderBy((F.col("base") - F.col("size")).asc(), "segment"))
    short = F.col("target") - F.sum("base").over(of_class)
    return counted.select(
        "segment", "label", "size",
        (F.col("base") + (rank <= short).cast("long")).alias("quota"))


def stratified_sample(segmented: DataFrame, quota: DataFrame, seed: int) -> DataFrame:
    """Exactly quota rows per (segment, label); the tail is kept whole."""
    ranked = drawn_ordinal(
        segmented.where(f"segment < {SEGMENTS}"), ["segment", "label"],
        draw_key(F.lit(seed), F.col("id"), F.col("idx")))
    kept = ranked.join(quota.select("segment", "label", "quota"), ["segment", "label"]).where(
        "ordinal < quota").select(*segmented.columns)
    return kept.unionByName(segmented.where(f"segment >= {SEGMENTS}"))


def new_positions(kept: DataFrame) -> DataFrame:
    """Where each segment bound lands after sampling: kept rows before the bound."""
    counts = kept.groupBy("segment").count()
    bounds = kept.sparkSession.range(SEGMENTS).select(F.col("id").cast("int").alias("segment"))  # a segment may have kept no row
    upto = Window.orderBy("segment")  # six rows
    return bounds.join(counts, "segment", "left").select(
        "segment", F.sum(F.coalesce("count", F.lit(0))).over(upto).alias("drift_point"))


def segment_shares(kept: DataFrame) -> DataFrame:
    return kept.groupBy("segment").agg(F.round(F.avg("label"), 3).alias("positive_share"))
