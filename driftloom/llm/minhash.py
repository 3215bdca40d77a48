"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of sketches, each of a few minhashes, are made for every distinct shingle set; the key of table
(i, j) is the pair of sketch i of the first collection and sketch j of the second. side ** 2 tables thus need only
2 * side * ROWS minhashes. Documents that meet in a table are compared on their full sets.

Equal sets are one class with a number of its own before any table is made, so a group of exact copies is one row. In a
table, members are first compared with the least of their bucket; what is linked counts as one component. What still lies in a bucket with other components goes through an exact prefix
filter on its full set (see `apart`): shingles in one order, those first that no second component has, then by rarity; a
pair at the wanted similarity shares a shingle near the front of both sets, at places that leave room for the overlap. So a
large group of near copies costs one comparison for each member, pairs that are alike but not enough end at their places
before a row is written, and no link between components is lost.

The side follows from the wanted similarity: a pair just there is missed by all tables with a probability of at most MISSED
(0.85: 8 sketches a side, 0.00098; 0.8: 11, 0.00075), more similar ones less often. Only documents that share a sketch of
both collections with another one can meet in a table, so the others are set aside before the keys are formed. Null, empty or blank text has no set and links with nothing; a document of fewer words than
a shingle is one shingle. Very long texts are read whole, as one set. Repeated ids: each row is a document of its own set,
and its component is the least id that it reaches; `one_of_each` drops all rows of an id that goes. A null id is kept and
links with nothing. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import oracles
from driftloom.llm import text as tx
from driftloom.llm.base import cut, query, table
from driftloom.llm.components import components

ROWS, MISSED = 3, 0.001
#: Entries of a shingle in one part of the join of prefixes.
PART = 4096
#: Shingles before a place that are kept with it.
BEFORE = 8
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, left array<long>, right array<long>"


def side_of(percent: int) -> int:
    """Sketches of a collection, so that a pair at this similarity is missed with a probability of at most MISSED."""
    return max(1, math.ceil(math.log(MISSED / 2) / math.log1p(-(min(percent, 99) / 100) ** ROWS)))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of n hash functions, the same in every run."""
    random = np.random.default_rng(20240229)
    return random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int):
    """For each document its distinct shingle hashes, in order (empty without words)."""
    w = tx.split(texts, tx.BLANKS)
    h = tx.hashes(w)
    runs = tx.rolling(h, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:
            yield tx.rolling(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.empty(0, dtype=np.uint64)


def signatures(docs: DataFrame, size: int, side: int) -> DataFrame:
    """doc_id, n_shingles, 128 bits of the set, and the two collections of sketches (empty without a set)."""
    multiply, add = coefficients(2 * side * ROWS)

    def sign(batches):
        for batch in tx.parts(batches):
            counts, digest, sketches, sizes = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                counts.append(len(s))
                sizes.append(side if len(s) else 0)
                digest.append(digests([s]))
                if len(s):
                    low = np.full(len(multiply), np.iinfo(np.uint64).max, dtype=np.uint64)
                    for i in range(0, len(s), 2048):
                        v = (s[i:i + 2048, None] * multiply + add)
                        np.minimum(low, v.min(axis=0), out=low)
                    low = tx.mixed(low).reshape(2 * side, ROWS)
                    sketches.append(tx.mixed(low[:, 0] * tx.GRAM + low[:, 1] * tx.BASE + low[:, 2:].sum(axis=1)))
            flat = np.concatenate([np.empty(0, dtype=np.uint64), *sketches]).reshape(-1, 2 * side).view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            d = np.concatenate([np.empty((0, 2), dtype=np.int64), *digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[:, :side].ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(flat[:, side:].ravel()))],
                names=["doc_id", "n_shingles", "s1", "s2", "left", "right"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, SIGNED)


def sharing(rows: DataFrame, column: str) -> DataFrame:
    """Ids that have a sketch of this collection in common with another id."""
    sketches = rows.select("id", F.posexplode(column).alias("i", "s"))
    shared = sketches.groupBy("i", "s").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("i", "s")
    return sketches.join(shared, ["i", "s"], "left_semi").select("id").distinct()


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two columns."""
    rows = [(int(s.sum()) & (2**64 - 1), int(tx.mixed(s).sum()) & (2**64 - 1)) if len(s) else (0, 0) for s in sets]
    return np.array(rows, dtype=np.uint64).reshape(-1, 2).view(np.int64)


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """id, n, shingles (distinct hashes) of the given classes (id, doc_id, n_shingles, s1, s2), read from their documents."""

    def sets(batches):
        for batch in tx.parts(batches):
            each = list(shingle_sets(batch.column("text"), size))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32))
            flat = np.concatenate([np.empty(0, dtype=np.uint64), *each]).view(np.int64)
            d = digests(each)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets.to_numpy()), pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "n_shingles", "s1", "s2", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = rows.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(
        sets, "doc_id long, n_shingles long, s1 long, s2 long, shingles array<long>")
    # an id may have other texts, of other classes, and the same one more than once
    return (read.join(classes, ["doc_id", "n_shingles", "s1", "s2"]).select("id", F.col("n_shingles").alias("n"), "shingles")
            .dropDuplicates(["id"]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb") - shared).alias("u"))
    return rows.where(F.col("n") * 100 >= F.col("u") * percent).select("a", "b")


def upper(x: Column, by: int) -> Column:
    """The least whole number that is not below x / by."""
    return F.floor((x + (by - 1)) / by)


def apart(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may have the similarity, from rows (id, n, component, shingles).

    Exact: all sets are put in one order, shingles of one component first, then by rarity. The first shingle that two sets
    share has all of their overlap behind it, so its place in a set of n leaves at least 100 * overlap >= percent * n, and
    in a pair at least percent / (100 + percent) of both sizes. Only pairs with such a place in both are given. Each shingle's
    entries of its largest component meet those of others only, in parts of about PART entries, so the many that are one
    component already cost nothing. A pair needs a row at its first shared shingle only. Each place carries the BEFORE
    shingles in front of it: one that both have is an earlier place of the same pair, which passes the same tests, so the
    later place gives no row. The first place never has one, so no pair is lost; a pair has a second row only where
    BEFORE places without a shared shingle lie between.
    """
    tokens = rows.select("id", "n", "component", F.explode("shingles").alias("token"))
    # a shingle within one component can be in no pair
    shared = (tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("x"), F.max("component").alias("y"))
              .where("x < y").select("token", "df"))
    own = Window.partitionBy("id")
    placed = (tokens.join(shared, "token").withColumn("m", F.count("*").over(own))
              .withColumn("at", F.col("n") - F.col("m") + F.row_number().over(own.orderBy("df", "token")) - 1)
              .withColumn("before", F.collect_list("token").over(own.orderBy("df", "token").rowsBetween(-BEFORE, -1))))
    prefix = cut(placed.where(F.col("at") <= F.col("n") - upper(F.col("n") * percent, 100))
                 .select("token", "id", "n", "component", "at", "before"), "prefixes")
    sizes = (prefix.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token")
             .agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("components")).where("components > 1")
             .select("token", F.col("most.component").alias("main"), upper(F.col("c"), PART).alias("parts")))
    known = prefix.join(sizes, "token")
    one = known.where("component != main").select(
        "token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("n").alias("na"),
        F.col("component").alias("ca"), F.col("at").alias("ia"), F.col("before").alias("ea"))
    two = known.select(
        "token", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"),
        F.col("at").alias("ib"), F.col("before").alias("eb"), (F.col("component") == F.col("main")).alias("largest"))
    overlap = upper((F.col("na") + F.col("nb")) * percent, 100 + percent)
    met = one.join(two, ["token", "part"]).where((F.col("ca") != F.col("cb")) & (F.col("largest") | (F.col("a") < F.col("b"))))
    met = met.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    met = met.where((F.col("na") - F.col("ia") >= overlap) & (F.col("nb") - F.col("ib") >= overlap))
    met = met.where(~F.arrays_overlap("ea", "eb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    signed = cut(signatures(docs, size, side_of(percent)), "signatures")
    alike = ["n_shingles", "s1", "s2"]
    known = signed.where("doc_id is not null and n_shingles > 0")
    # numbers of the written table; the least of an id's classes is not told apart by its id
    classes = cut(known.groupBy(*alike).agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("left", "right")).alias("x"))
                  .select(*alike, "doc_id", F.col("x.left").alias("left"), F.col("x.right").alias("right"))
                  .withColumn("id", F.monotonically_increasing_id()), "classes")
    able = classes.select("id", "n_shingles", "left", "right")
    for column in ("left", "right"):
        able = cut(able.join(sharing(able, column), "id", "left_semi"), "able")
    keys = (able.select("id", "n_shingles", F.posexplode("left").alias("i", "l"), "right")
            .select("id", "n_shingles", "i", "l", F.posexplode("right").alias("j", "r"))
            .select(F.xxhash64("i", "j", "l", "r").alias("key"), "id", "n_shingles"))
    # a bucket of one makes no pair
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    members = cut(keys.join(least.select("key", "least"), "key"), "members")
    met = members.select("id").distinct()
    sets = cut(full_sets(docs, classes.select("id", "doc_id", *alike).join(met, "id", "left_semi"), size), "sets")

    def grown(links: DataFrame, before: DataFrame | None) -> DataFrame:
        """Components by these links and by those before."""
        known = links if before is None else links.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return cut(components(known), "components")

    def placed(joined: DataFrame) -> DataFrame:
        return members.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    # the least of each bucket with all others
    star = cut(members.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    joined = grown(cut(verified(star, sets, percent), "verified"), None)
    # what lies in buckets that still have more than one component, by prefixes of the full sets
    open_keys = placed(joined).groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    still = cut(placed(joined).join(open_keys.select("key"), "key", "left_semi").select("id", "component").distinct(), "still-apart")
    last = cut(apart(sets.join(still, "id"), percent), "pairs")
    joined = grown(cut(verified(last, sets, percent), "verified"), joined)

    of_class = cut(classes.select(*alike, "id", "doc_id").join(joined.withColumnRenamed("node", "id"), "id", "left")
                   .withColumn("component", F.coalesce("component", "id")), "class-components")
    first = of_class.groupBy("component").agg(F.min("doc_id").alias("first"))
    of_class = of_class.join(first, "component").select(*alike, "first")
    grouped = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("first")).otherwise(F.col("doc_id"))
    return (signed.select("doc_id", *alike).join(of_class, alike, "left")
            .select("doc_id", "n_shingles", grouped.alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` but those that have a smaller id in their group; rows without an id stay."""
    later = groups(docs, size, percent).where("doc_id != component_id").select(F.col("doc_id").alias("later_doc_id")).distinct()
    return docs.join(later, docs["doc_id"] == later["later_doc_id"], "left_anti")


@query("op10_minhash", oracles.MINHASH)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
