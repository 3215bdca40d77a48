"""Collocations: phrases of two or three words that occur together far more often than their parts, for each language.

Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line ends, and pieces into words at blanks and tabs. Every
n-gram within a piece gets a Rabin-Karp fingerprint, sum of h_i * B ** (n - 1 - i) modulo 2 ** 64 over the fingerprints h
of its words, from prefix sums of a whole batch of texts. A block of texts sends one row for each distinct n-gram: its
fingerprint, the fingerprints of its first and last word, the count, and the document of one occurrence; Spark adds up.
As the polynomial can be solved for any one word, two words are told by (fingerprint, first) and three by (fingerprint,
first, last) without doubt once no two words of a language share a fingerprint, and the fingerprints of all parts of a
phrase follow by arithmetic. An n-gram is only sent if both n-grams of one word less within it are frequent (bit sets of
fixed size; a full set lets more through, results stay whole).

Collisions: each word carries a second, independent fingerprint, and each reported phrase is read from the texts of its
least and its greatest document and must be the same there. If either differs, all is done again with another salt.
Only phrases that can be among the reported ones are ever turned into text.

A phrase scores floor(10 ** 6 * a * a / (l * r)), with a, l and r the counts of the phrase and of its two parts at the cut
that scores least (ties: the first cut). Phrases of two words that stand inside a frequent longer one with at least COVER
percent of their count go. Null text is empty, a null language is `und`; languages without frequent phrases give no rows;
equal texts count as often as they stand in the table; texts of any length are processed whole, one at a time if they
are long. Ties of score and count are ordered by the bytes of the phrase. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm import oracles
from driftloom.llm import text as tx
from driftloom.llm.base import bit_set, cut, query, table

U64 = np.uint64
LEAST, COVER, TOP = 10, 50, 2000
#: Words of a block, about; bits of the sets of frequent words and pairs, and of wanted documents and places.
TOKENS, WORD_BITS, PAIR_BITS, PLACE_BITS = 1_000_000, 26, 27, 26
#: Rows of one batch sent back.
ROWS = 50_000
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[ord(c) for c in ".,;:!?"]] = BREAKS[0x0A:0x0E] = True
INSIDE = ~BREAKS
INSIDE[[0x20, 0x09]] = False
#: A second base for the fingerprints of words, odd as the first.
OTHER = U64(0xC2B2AE3D27D4EB4F)
KEY = {2: ["fp", "first"], 3: ["fp", "first", "last"]}


def inverse(base: U64) -> U64:
    return U64(pow(int(base), -1, 1 << 64))


def prints(h: np.ndarray, n: int, base: U64 = tx.BASE) -> np.ndarray:
    """Fingerprint of h[i : i + n] for every i, by prefix polynomials."""
    if len(h) < n:
        return np.empty(0, dtype=U64)
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * tx.powers(inverse(base), len(h))[:len(h)], out=sums[1:])
    return (sums[n:] - sums[:-n]) * tx.powers(base, len(h))[n - 1:len(h)]


def word_prints(words: tx.Words, base: U64) -> np.ndarray:
    """Fingerprint of the bytes of each word, from prefix polynomials over steps of the text."""
    out = np.empty(len(words.starts), dtype=U64)
    i = 0
    while i < len(out):
        at = words.starts[i]
        j = max(i + 1, int(np.searchsorted(words.ends, at + tx.STEP_BYTES, side="right")))
        span = words.data[at:words.ends[j - 1]]
        sums = np.zeros(len(span) + 1, dtype=U64)
        np.cumsum((span.astype(U64) + U64(1)) * tx.powers(inverse(base), len(span))[:len(span)], out=sums[1:])
        s, e = words.starts[i:j] - at, words.ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * tx.powers(base, len(span))[e - 1]
        i = j
    return tx.mixed(out)


def salt_of(lang: str, salt: int) -> U64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little"))


@dataclass
class Piecewise:
    """Words of a batch of documents with their fingerprints; `follows` marks a word that continues the piece of the one before."""

    words: tx.Words
    h: np.ndarray
    follows: np.ndarray
    lang: np.ndarray
    doc: np.ndarray

    def spans(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are one piece."""
        total = max(0, len(self.h) - n + 1)
        fine = np.ones(total, dtype=bool)
        for k in range(1, n):
            fine &= self.follows[k:k + total]
        return fine


def read(batch: pa.RecordBatch, salt: int, langs: dict[str, int]) -> Piecewise:
    """`langs` numbers the languages met so far and grows here."""
    w = tx.split(batch.column("text"), INSIDE)
    counts = w.counts()
    names = batch.column("lang").to_pylist()
    number = np.array([langs.setdefault(x, len(langs)) for x in names], dtype=np.int64)
    salts = np.array([salt_of(x, salt) for x in langs], dtype=U64)
    piece = np.concatenate([[0], np.cumsum(BREAKS[w.data])])[w.starts]
    doc = np.repeat(np.arange(len(counts)), counts)
    follows = np.zeros(len(doc), dtype=bool)
    follows[1:] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    lang = number[doc]
    h = tx.mixed(word_prints(w, tx.BASE) ^ salts[lang]) if len(doc) else np.empty(0, dtype=U64)
    return Piecewise(w, h, follows, lang, batch.column("doc").to_numpy()[doc])


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each distinct row of the columns."""
    key = np.zeros(len(columns[0]), dtype=U64)
    for c in columns:
        key = tx.mixed(key * tx.GRAM + c.astype(U64))
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.ones(len(key), dtype=bool)
    begins[1:] = key[1:] != key[:-1]
    edge = np.flatnonzero(begins)
    at, n = order[edge], np.diff(np.append(edge, len(key)))
    if any((c[order][1:] != c[order][:-1])[~begins[1:]].any() for c in columns):
        # the mixed key is not enough: by the rows themselves
        _, at, n = np.unique(np.stack([c.astype(U64) for c in columns], axis=1), axis=0, return_index=True, return_counts=True)
    return at, n


def blocks(batches: Iterator[pa.RecordBatch], salt: int, take) -> Iterator[tuple[list[np.ndarray], list[str]]]:
    """take(piecewise) for batches of texts, put together to blocks of about TOKENS words; and the languages by number."""
    held, size, langs = [], 0, {}
    for batch in tx.parts(batches):
        p = read(batch, salt, langs)
        held.append(take(p))
        size += len(p.h)
        if size >= TOKENS:
            yield [np.concatenate(c) for c in zip(*held)], list(langs)
            held, size, langs = [], 0, {}
    if held:
        yield [np.concatenate(c) for c in zip(*held)], list(langs)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def named(number: np.ndarray, langs: list[str]) -> pa.Array:
    return pa.array(langs, pa.string()).take(pa.array(number))


def sent(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def word_counts(docs: DataFrame, salt: int, least: int) -> DataFrame:
    """lang, h, n, c1, c2 (least and greatest second fingerprint) of words that are frequent or clash; h is null in the row
    of all words of a language."""

    def count(batches):
        for (lang, h, c), langs in blocks(batches, salt, lambda p: (p.lang, p.h, word_prints(p.words, OTHER))):
            at, n = distinct([h, c, lang.astype(U64)])
            total = np.bincount(lang, minlength=len(langs))
            empty = pa.nulls(len(total), pa.int64())
            for some in ([named(lang[at], langs), signed(h[at]), pa.array(n.astype(np.int64)), signed(c[at])],
                         [pa.array(langs, pa.string()), empty, pa.array(total.astype(np.int64)), empty]):
                yield from sent(some, ["lang", "h", "n", "c"])

    rows = docs.mapInArrow(count, "lang string, h long, n long, c long").groupBy("lang", "h")
    return rows.agg(F.sum("n").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where(
        F.col("h").isNull() | (F.col("n") >= least) | (F.col("c1") != F.col("c2")))


def phrase_counts(docs: DataFrame, n: int, salt: int, least: int, known) -> DataFrame:
    """lang, key columns, a, d1, d2 (least and greatest document met) of the frequent phrases of n words.

    `known` is a broadcast bit set of the frequent phrases of one word less.
    """
    key = KEY[n]

    def take(p: Piecewise):
        fine = p.spans(n)
        part = tx.in_bits(known.value, prints(p.h, n - 1))
        i = np.flatnonzero(fine & part[:-1] & part[1:]) if len(fine) else np.empty(0, dtype=np.int64)
        columns = {"fp": prints(p.h, n), "first": p.h, "last": p.h[n - 1:]}
        return (p.lang[i], p.doc[i], *[columns[k][i] for k in key])

    def count(batches):
        for (lang, doc, *columns), langs in blocks(batches, salt, take):
            at, times = distinct([*columns, lang.astype(U64)])
            yield from sent([named(lang[at], langs), *[signed(c[at]) for c in columns], pa.array(times.astype(np.int64)), pa.array(doc[at])],
                            ["lang", *key, "n", "doc"])

    rows = docs.mapInArrow(count, "lang string, " + ", ".join(f"{k} long" for k in key) + ", n long, doc long")
    return rows.groupBy("lang", *key).agg(F.sum("n").alias("a"), F.min("doc").alias("d1"), F.max("doc").alias("d2")).where(F.col("a") >= least)


def with_parts(found: DataFrame, n: int) -> DataFrame:
    """Adds the fingerprints of a phrase's parts, solved from its own: second (and left, right, the pairs of a triple)."""
    base, back = tx.BASE, inverse(tx.BASE)
    more = ["second"] if n == 2 else ["second", "left", "right"]

    def solve(batches):
        for batch in batches:
            fp, first = (batch.column(c).to_numpy().view(U64) for c in ("fp", "first"))
            if n == 2:
                out = [fp - first * base]
            else:
                last = batch.column("last").to_numpy().view(U64)
                right = fp - first * base * base
                out = [(right - last) * back, (fp - last) * back, right]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[signed(x) for x in out]], names=[*batch.schema.names, *more])

    return found.mapInArrow(solve, found.schema.simpleString()[len("struct<"):-1].replace(":", " ") + "".join(f", {c} long" for c in more))


def score(a: str, left: str, right: str) -> Column:
    """floor(10 ** 6 * a * a / (left * right)) in decimals of 38 digits."""
    square = f"cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({square})) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """lang, words, fp, first, last (0 for pairs), a, l, r, score, d1, d2 of all frequent phrases."""

    def word(column: str, count: str) -> DataFrame:
        return words.select("lang", F.col("h").alias(column), F.col("n").alias(count))

    two = with_parts(pairs, 2).join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    two = two.select("lang", F.lit(2).alias("words"), "fp", "first", F.lit(0).cast("long").alias("last"), "a", "l", "r", score("a", "l", "r").alias("score"), "d1", "d2")
    left = pairs.select("lang", F.col("fp").alias("left"), "first", F.col("a").alias("l2"))
    right = pairs.select("lang", F.col("fp").alias("right"), F.col("first").alias("second"), F.col("a").alias("r1"))
    three = (with_parts(triples, 3).join(left, ["lang", "left", "first"]).join(right, ["lang", "right", "second"])
             .join(word("first", "l1"), ["lang", "first"]).join(word("last", "r2"), ["lang", "last"])
             .withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2")))
    one = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.lit(3).alias("words"), "fp", "first", "last", "a", F.when(one, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(one, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"), "d1", "d2")
    return two.union(three)


def uncovered(found: DataFrame, triples: DataFrame, cover: int) -> DataFrame:
    """`found` without the pairs that stand inside a triple with at least `cover` percent of their count."""
    parts = with_parts(triples, 3)
    inside = parts.select("lang", F.col("left").alias("fp"), "first", F.col("a").alias("longer")).union(
        parts.select("lang", "right", "second", "a"))
    most = inside.groupBy("lang", "fp", "first").agg(F.max("longer").alias("longer")).withColumn("words", F.lit(2))
    rows = found.join(most, ["lang", "words", "fp", "first"], "left")
    return rows.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)).drop("longer")


def leading(found: DataFrame, top: int) -> DataFrame:
    """Rows that can be among the first `top` of their language: those ahead of or level with the last of these."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = found.select("lang", "score", "a", F.row_number().over(order).alias("place")).where(F.col("place") <= top)
    edge = first.groupBy("lang").agg(F.min("score").alias("edge"), F.min(F.struct("score", "a"))["a"].alias("edge_a"))
    ahead = (F.col("score") > F.col("edge")) | ((F.col("score") == F.col("edge")) & (F.col("a") >= F.col("edge_a")))
    return found.join(edge, "lang").where(ahead).drop("edge", "edge_a")


def place_of(fp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tx.mixed(fp ^ tx.mixed(doc.view(U64)))


def read_back(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """lang, words, key, doc, phrase: the text of each wanted phrase in each of its documents (d1, d2)."""

    def places(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U64)
            for d in ("d1", "d2"):
                doc = batch.column(d).to_numpy()
                yield pa.RecordBatch.from_arrays([signed(tx.mixed(doc.view(U64))), signed(place_of(fp, doc))], names=["doc", "place"])

    spots = cut(wanted.mapInArrow(places, "doc long, place long"), "phrase-places")
    context = docs.sparkSession.sparkContext
    in_docs, in_places = (context.broadcast(bit_set(spots, c, PLACE_BITS)) for c in ("doc", "place"))

    def texts(batches):
        for batch in tx.parts(batches):
            batch = batch.filter(pa.array(tx.in_bits(in_docs.value, tx.mixed(batch.column("doc").to_numpy().view(U64)))))
            if not batch.num_rows:
                continue
            langs: dict[str, int] = {}
            p = read(batch, salt, langs)
            names = list(langs)
            out = []
            for n in KEY:
                fp = prints(p.h, n)
                i = np.flatnonzero(p.spans(n) & tx.in_bits(in_places.value, place_of(fp, p.doc[:len(fp)])))
                last = p.h[i + n - 1] if n == 3 else np.zeros(len(i), dtype=U64)
                at, _ = distinct([fp[i], p.doc[i].view(U64), p.h[i], last, p.lang[i].astype(U64)])
                for k in at:
                    j = int(i[k])
                    phrase = b" ".join(p.words.word(x) for x in range(j, j + n)).decode()
                    out.append((names[p.lang[j]], n, int(fp[j].view(np.int64)), int(p.h[j].view(np.int64)), int(last[k].view(np.int64)), int(p.doc[j]), phrase))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, FOUND.types)], names=FOUND.names)

    return docs.mapInArrow(texts, "lang string, words int, fp long, first long, last long, doc long, phrase string")


FOUND = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("fp", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("doc", pa.int64()), ("phrase", pa.string())])


def attempt(docs: DataFrame, least: int, cover: int, top: int, salt: int) -> DataFrame | None:
    """The phrases, or None if two words or phrases share a fingerprint under this salt."""
    context = docs.sparkSession.sparkContext
    words = cut(word_counts(docs, salt, least), "words")
    if not words.where("c1 != c2").isEmpty():
        return None
    frequent = words.where("h is not null").select("lang", "h", "n")
    pairs = cut(phrase_counts(docs, 2, salt, least, context.broadcast(bit_set(frequent, "h", WORD_BITS))), "pairs")
    triples = cut(phrase_counts(docs, 3, salt, least, context.broadcast(bit_set(pairs, "fp", PAIR_BITS))), "triples")
    found = cut(leading(cut(uncovered(scored(frequent, pairs, triples), triples, cover), "phrase-scores"), top), "phrase-leaders")
    key = ["lang", "words", "fp", "first", "last"]
    told = read_back(docs, found, salt).join(found.select(*key, "d1", "d2"), key).where("doc = d1 or doc = d2")
    texts = cut(told.groupBy(*key).agg(F.min("phrase").alias("phrase"), F.max("phrase").alias("other")), "phrase-texts")
    if not texts.where("phrase != other").isEmpty():
        return None
    totals = words.where("h is null").select("lang", F.col("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = found.join(texts.drop("other"), key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score", F.col("words").cast("long").alias("words"))


def phrases(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, salts: int = 8) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, words of the first `top` phrases of each language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("lang", "text", F.xxhash64("lang", "text").alias("doc"))
    for salt in range(salts):
        found = attempt(rows, least, cover, top, salt)
        if found is not None:
            return found
    raise RuntimeError(f"words share fingerprints under {salts} salts")


@query("op13_phrases", oracles.PHRASES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents")).drop("words")
