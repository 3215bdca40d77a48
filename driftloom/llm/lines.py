"""Near-duplicate lines, by an exact set-similarity join in DataFrame operations only.

A line is the set of its lower-cased words, the runs without a space. A line goes if an earlier line of
the corpus, in order of (doc_id, line number), has a Jaccard similarity of at least PERCENT with it; matches are judged
on the input. Lines of equal sets are one class first, so a line that stands in a third of all documents is one row.

The join is by prefix filter: words are put in order of rarity, and two sets of the required similarity share a word
among the first n - ceil(t * n) + 1 of each, and a second one within one place more. Rarity is a count for each of
2 ** RARITY_BITS word buckets (a table of fixed size, sent with the plan as a literal of one byte each), ties by hash; any common order gives
the same result, rare words first only make it quick. A line is listed under each rare word of its prefix, and under each pair
of a frequent word of its prefix and a word behind it: lines that share such a pair are few, however often the words come.
What meets must pass the length filter and the parity filter (64 or 128 parities of the words of a set, which differ in no
more places than the sets do), and is then verified on its full sets. Lists are made in passes over the first words, so that what
lies in a shuffle at once follows the number of lines.
Lines of a list that many share are first compared with the earliest few of them; lines that found their match need no
other, which spares groups of near copies their pairs.

Null text has no lines; lines without words stay and match nothing; a null doc_id comes last. Rows of equal ids are told
apart by a hash of their texts, and equal rows share their results. Other columns ride along in `clean`.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import oracles
from driftloom.llm.base import query, table
from driftloom.session import cut_tidily, release

PERCENT = 80
RARITY_BITS = 18
#: A word of so many lines is listed by itself, beside the mean of a bucket; a more frequent one with a second word.
SELDOM = 64
#: Lists of so many lines have these compared with so many of their earliest lines before others.
MANY, EARLIEST = 50, 8
#: Sets of more words than this have 128 parities.
WIDE = 64
#: Rows of lists that a pass may have for each line, and that it may have in any case.
PASS_ROWS, PASS_LEAST = 6, 4_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """d (doc_id), t (hash of the text), line (number from 0) and the lower-cased text of every line that has a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    return rows.select("d", "t", F.posexplode("lines").alias("line", "text")).where(F.trim("text") != "").withColumn("text", F.lower("text"))


def needed(n: Column) -> Column:
    """Least overlap of a set of n words with one that is similar enough: ceil(t * n)."""
    return F.ceil(n * PERCENT / 100).cast("int")


def level(n: Column) -> Column:
    """A count as quarters of a power of two, from 1 to 127."""
    return F.greatest(F.lit(1), F.least(F.lit(127), F.floor(F.log2(n) * 4))).cast("byte")


def rarity(docs: DataFrame) -> tuple[Column, int]:
    """Literal of one byte for each bucket: how many words of all lines fall into it, as a level; and the least token of a frequent word."""
    size = 1 << RARITY_BITS
    counts = (lines_of(docs).select(F.explode(F.split("text", " ")).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(size - 1).cast("int").alias("bucket"))
              .agg(F.count("*").alias("n")))
    counts = cut_tidily(counts, "line-words")
    words = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.select("bucket", level(F.col("n")).alias("level")).toArrow()  # 2 ** RARITY_BITS rows at most
    release(counts)
    levels = np.ones(size, dtype=np.uint8)
    levels[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    frequent = math.ceil(math.log2(SELDOM + words / size) * 4)
    return F.lit(levels.tobytes()), (min(frequent, 127) - 128) << 56


def tokens(line: Column, levels: Column) -> Column:
    """Distinct words of a line as numbers in order of rarity: the level in the top byte, 56 bits of hash below it."""
    size = 1 << RARITY_BITS

    def number(h: Column) -> Column:
        place = (h.bitwiseAND(size - 1) + 1).cast("int")
        rare = F.ascii(F.call_function("substring", levels, place, F.lit(1)).cast("string"))
        return F.shiftleft(rare.cast("long") - 128, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    return F.sort_array(F.array_distinct(F.transform(hashes, number)))


def parities(numbers: Column) -> Column:
    """bits: 64 bits, each the parity of the words that fall on it; half: the same of about half the words, for large sets only."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def of(some: Column) -> Column:
        return F.aggregate(some, none, lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))))

    half = F.when(F.size(numbers) > WIDE, of(F.filter(numbers, lambda x: x.bitwiseAND(64) != 0))).otherwise(none)
    return F.struct(of(numbers).alias("bits"), half.alias("half"))


def n_similar(n: Column) -> Column:
    """Whether sets of n words can be similar to others."""
    return n * 100 >= (n + 1) * PERCENT


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (early, late) whose sets have 100 * intersection >= PERCENT * union."""
    one = sets.select(F.col("id").alias("early"), F.col("tokens").alias("x"))
    two = sets.select(F.col("id").alias("late"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(one, "early").join(two, "late").select("early", "late", both.alias("n"), (F.size("x") + F.size("y") - both).alias("u"))
            .where(F.col("n") * 100 >= F.col("u") * PERCENT).select("early", "late"))


def possible(one: str, two: str) -> Column:
    """Length and parity filters: similar sets of a and b words differ in (a + b) * (1 - t) / (1 + t) words at most."""
    a, b = F.col(f"{one}.n"), F.col(f"{two}.n")
    bits, half = (F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}")) for c in ("bits", "half"))
    apart = F.when((a > WIDE) & (b > WIDE), F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half))).otherwise(F.bit_count(bits))
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT) & (apart * (100 + PERCENT) <= (a + b) * (100 - PERCENT))


def numbered(lines: DataFrame) -> Column:
    """A column that orders lines by (doc_id, text hash, number): one packed number if ids are distinct and fit, else a struct."""
    r = lines.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("line").alias("most"), F.max(F.col("d").isNull()).alias("none")).first()
    plain = lines.select("d", "t").distinct().groupBy("d").count().where("count > 1").isEmpty()
    if r["low"] is not None and plain and not r["none"]:
        bits = int(r["most"]).bit_length()
        if (int(r["high"]) - int(r["low"])).bit_length() + bits <= 62:
            return F.shiftleft(F.col("d") - int(r["low"]), bits).bitwiseOR(F.col("line").cast("long"))
    return F.struct(F.col("d").isNull().alias("z"), "d", "t", "line")


def passes(classes: DataFrame, frequent: int) -> list[DataFrame]:
    """id, of (n, bits, half) and list of every class (id, of, prefix) in each list that it stands in, as parts of which each has whole lists."""
    of_line = classes.select("id", "of", "prefix", F.posexplode("prefix").alias("place", "token"))
    behind = F.size("prefix") - 1 - F.col("place")
    of_line = of_line.where(behind > 0)  # the last word is a second one only
    r = of_line.agg(F.sum(F.when(F.col("token") >= frequent, behind).otherwise(1)).alias("rows"), F.sum((F.col("place") == 0).cast("int")).alias("lines")).first()
    parts = max(1, math.ceil((r["rows"] or 0) / max(PASS_LEAST, PASS_ROWS * (r["lines"] or 0))))
    seconds = F.when(F.col("token") >= frequent, F.slice("prefix", F.col("place") + 2, behind)).otherwise(F.array(F.lit(None).cast("long")))
    name = F.when(F.col("second").isNull(), F.col("token")).otherwise(F.xxhash64("token", "second"))
    return [of_line.where(F.pmod("token", F.lit(parts)) == part).select("id", "of", "token", F.explode(seconds).alias("second"))
            .select("id", "of", name.alias("list")) for part in range(parts)]


def later_classes(classes: DataFrame, frequent: int, sets_of) -> DataFrame:
    """Ids of classes (id, of, prefix) that have a similar earlier class; sets_of(pairs) gives the full sets."""
    of_list = Window.partitionBy("list")
    met = []
    for listed in passes(classes, frequent):
        found = listed.withColumn("turn", F.row_number().over(of_list.orderBy("id"))).withColumn("members", F.count("*").over(of_list))
        met.append(cut_tidily(found.where("members > 1"), "line-matches"))
    release(classes)

    def pairs_in(late: DataFrame, early: DataFrame) -> DataFrame:
        one = early.select(F.col("id").alias("early"), F.col("of").alias("one"), "list")
        two = late.select(F.col("id").alias("late"), F.col("of").alias("two"), "list")
        return two.join(one, "list").where("early < late").where(possible("one", "two")).select("early", "late")

    # lists of many lines: their earliest lines first
    many = F.col("members") >= MANY
    near = [pairs_in(m.where(many), m.where(many & (F.col("turn") <= EARLIEST))) for m in met]
    tried = cut_tidily(reduce(DataFrame.union, near).distinct(), "line-pairs")
    sets = sets_of(tried)
    gone = cut_tidily(similar(tried, sets).select(F.col("late").alias("id")).distinct(), "line-later")
    release(sets)
    # what has no match yet meets all earlier lines of its lists
    pairs = []
    for m in met:
        pairs.append(cut_tidily(pairs_in(m.join(gone, "id", "left_anti"), m).distinct(), "line-pairs"))
        release(m)
    rest = cut_tidily(reduce(DataFrame.union, pairs).distinct().join(tried, ["early", "late"], "left_anti"), "line-pairs")
    release(tried, *pairs)
    sets = sets_of(rest)
    late = cut_tidily(gone.union(similar(rest, sets).select(F.col("late").alias("id")).distinct()), "line-later")
    release(sets, rest, gone)
    return late


def repeated_lines(docs: DataFrame) -> DataFrame:
    """d, t and the sorted numbers of the lines that go, for each document that loses some."""
    levels, frequent = rarity(docs)
    known = lines_of(docs).select("d", "t", "line", tokens(F.col("text"), levels).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), F.least(n, n - needed(n) + 2))
    key = ["k1", "k2"]
    whole = cut_tidily(known.select("d", "t", "line", F.xxhash64("tokens").alias("k1"), F.hash("tokens").alias("k2"), n.alias("n"), parities(F.col("tokens")).alias("p"), prefix.alias("prefix")), "lines")
    number = numbered(whole)
    lines = cut_tidily(whole.select("d", "t", "line", *key, number.alias("id")), "lines")
    classes = cut_tidily(lines.groupBy(*key).agg(F.min(F.struct("id", "d", "t", "line")).alias("x")).select(*key, "x.*"), "line-classes")
    # a set of n words has a similar one beside itself only if a word more or less is little enough
    some = whole.where(n_similar(F.col("n"))).select(number.alias("id"), F.struct("n", "p.bits", "p.half").alias("of"), "prefix")
    listed = cut_tidily(some.join(classes.select("id"), "id", "left_semi"), "line-classes")
    release(whole)

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("early").alias("id")).union(pairs.select(F.col("late").alias("id"))).distinct()
        where = classes.select("id", "d", "t", "line").join(ids, "id")
        wanted = where.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("line", "id"))).alias("ids"))
        texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
        rows = texts.join(wanted, texts["d"].eqNullSafe(wanted["d"]) & (texts["t"] == wanted["t"])).select("lines", F.explode("ids").alias("line", "id"))
        # the table of rarity stands in short plans only: Spark's driver keeps the text of each plan, at every step of a long one
        found = cut_tidily(rows.select("id", F.lower(F.get("lines", F.col("line"))).alias("text")).dropDuplicates(["id"]), "line-texts")
        sets = cut_tidily(found.select("id", tokens(F.col("text"), levels).alias("tokens")), "line-sets")
        release(found)
        return sets

    late = later_classes(listed, frequent, sets_of)  # releases `listed`
    status = classes.select(*key, "id").join(late.withColumn("late", F.lit(True)), "id", "left").select(*key, F.col("id").alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
    gone = lines.select("d", "t", "line", "id", *key).join(status, key).where(F.col("late") | (F.col("id") != F.col("first")))
    gone = cut_tidily(gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("line")).alias("gone")), "lines-gone")
    release(lines, classes, late)
    return gone


def clean(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated lines taken out of `text`, all columns kept in order."""
    gone = repeated_lines(docs)
    key = (docs["doc_id"].cast("long").eqNullSafe(gone["d"])) & (F.xxhash64(docs["text"]) == gone["t"])
    kept = F.filter(F.split(docs["text"], "\n", -1), lambda _, i: ~F.array_contains(gone["gone"], i))
    text = F.when(gone["gone"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, key, "left").select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


@query("op4_line_dedup", oracles.LINES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = repeated_lines(docs)
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    base = docs.select("doc_id", F.xxhash64("text").alias("t"), F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"))
    return base.join(gone, (base["doc_id"].eqNullSafe(gone["d"])) & (base["t"] == gone["t"]), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))
