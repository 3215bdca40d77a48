"""Connected components of a table of links by alternating star joins; nothing is gathered outside the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.base import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable) for the nodes of links (a, b); self links are ignored.

    Each round hangs larger neighbours and then smaller ones on the least one (map-side minima, one join); the rounds are
    logarithmic in the number of nodes, not in the length of chains. Each round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    edges, before = cut(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"), None
    while True:
        # equal numbers of rows and equal sums of their hashes: nothing moved in the last round
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.select("a", "b").union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(b.alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        # b is the only smaller neighbour: the star stays as it is
        step = small.select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = cut(step, "links")
    return edges.groupBy(a.alias("node")).agg(F.min("b").alias("component")).union(
        edges.select(b.alias("node"), b.alias("component")).distinct())
