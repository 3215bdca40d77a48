"""Prequential multinomial naive Bayes as relational plans.

Every row is scored from the state just before it and then becomes part of that state, so the
state is a running aggregate and no row-at-a-time loop is needed. A *segment* says which rows
are scored by what: rows lo..hi of a stream are scored by a model trained on all rows since
row b, with ageing rate lam and smoothing alpha. A stable model is one segment; a changed rate
or a rebuild starts the next one.

    instances  stream, seed, idx, t, label, bag      (a table: it is read more than once)
    segments   stream, seed, b, lam, alpha, lo, hi, and `since` where rows b..since-1 are in a carried state

Ageing weighs a count by the time since its *last* sight, so the normaliser of a class is a sum
over its whole vocabulary. It is kept as a decayed running sum of per-row changes. That sum depends
on the start b and the rate, not on where a segment begins, so all segments of one start, rate and
smoothing are one *track* over the rows from b on, and a model that changes its rate picks its rows
from several tracks. A `State` holds what the rows up to a cut have taught (counts and last times of
every word and class); a run can start from one and reads the rows behind the cut only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.prefix import BLOCK_ROWS, block_of, blocks_between, running, running_near, tasks_for
from driftloom.session import cut

STREAM = ["stream", "seed"]
START = [*STREAM, "b", "since"]
# Scores closer than rounding noise are a tie, and a tie is class 0. Without the margin the
# order of a distributed sum could decide an exact tie.
TIE_ABSOLUTE = 1e-9
TIE_RELATIVE = 1e-12


def of_class(c: int, value: Column) -> Column:
    return F.when(F.col("label") == c, value)


def majority(instances: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Majority class of all earlier rows; a tie is class 0."""
    rows = instances.select(*STREAM, "idx", "label", block_of(F.col("idx"), block_rows).alias("blk"))
    counts = running(rows, STREAM, "idx", "blk", sums={
        "n0": F.when(F.col("label") == 0, 1).otherwise(0),
        "n1": F.when(F.col("label") == 1, 1).otherwise(0),
    })
    return counts.drop("blk").withColumn("pred", (F.col("n1") > F.col("n0")).cast("int"))


def segment_id() -> Column:
    return F.xxhash64("b", "since", "lam", "alpha")


@dataclass
class State:
    """What rows b..since-1 have taught, by (stream, seed, b, since).

    words  word, m0, m1 (count per class), u0, u1 (last time per class)
    docs   n0, n1 (rows per class), t0, t1 (last time per class)
    """

    words: DataFrame
    docs: DataFrame


def with_since(table: DataFrame) -> DataFrame:
    return table if "since" in table.columns else table.withColumn("since", F.col("b"))


def _word_rows(instances: DataFrame, starts: DataFrame, block_rows: int, carried: State | None, marks: bool = False) -> DataFrame:
    """Words of the rows since..end with their part of the counts (a0, a1) and times (x0, x1), and the carried ones
    as rows without a label just before.

    With `marks` every row has one more line, without a word and with `k` 0, that teaches nothing: rows without tokens must stay.
    """
    bag = F.concat(F.coalesce("bag", F.array()), F.array(F.lit(None))) if marks else F.col("bag")
    lines = _trained(instances, starts, block_rows).select(*START, "end", "blk", "idx", "t", "label", F.explode(bag).alias("_line")).select(
        *START, "end", "blk", "idx", "t", "label", F.col("_line.word").alias("word"), F.col("_line.k").alias("k"))
    words = lines.select(
        "*", *[of_class(c, F.col("k")).alias(f"a{c}") for c in (0, 1)],
        *[F.when(F.col("k").isNotNull(), of_class(c, F.col("t"))).alias(f"x{c}") for c in (0, 1)])
    if carried is None:
        return words
    before = F.col("since") - 1
    known = carried.words.join(starts.select(*START, "end"), START).select(
        *START, "end", block_of(before, block_rows).alias("blk"), before.alias("idx"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("int").alias("label"),
        "word", F.lit(None).cast("long").alias("k"), *[F.col(f"m{c}").alias(f"a{c}") for c in (0, 1)], *[F.col(f"u{c}").alias(f"x{c}") for c in (0, 1)])
    return words.unionByName(known)


def words_read(instances: DataFrame, tracks: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """How many lines the rows since..end of all tracks have: their words and a mark for each row."""
    spans = blocks_between(tracks, "since", "end", block_rows).groupBy(*STREAM, "blk").agg(F.count(F.lit(1)).alias("times"))
    rows = instances.select(*STREAM, block_of(F.col("idx"), block_rows).alias("blk"), (F.greatest(F.size("bag"), F.lit(0)) + 1).alias("n"))
    per_block = rows.groupBy(*STREAM, "blk").agg(F.sum("n").alias("n")).join(spans, [*STREAM, "blk"])
    return per_block.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0


def word_state(
    instances: DataFrame, starts: DataFrame, block_rows: int = BLOCK_ROWS, carried: State | None = None, marks: bool = False, parts: int | None = None,
) -> DataFrame:
    """Counts and last times of each row's words just before the row.

    `starts` holds one row per (stream, seed, b, since) with `end`, the last row that needs it. Adds
    m0, m1 (count per class) and u0, u1 (last time per class) to (.., b, since, word, idx, t, label, k). With `marks` every row
    has a line with `k` NULL, too. The lines of a block lie together, in `parts` tasks if given.
    """
    words = _word_rows(instances, with_since(starts), block_rows, carried, marks)
    state = running_near(
        words, [*START, "word"], START, "idx", "blk",
        sums={f"m{c}": F.col(f"a{c}") for c in (0, 1)}, maxes={f"u{c}": F.col(f"x{c}") for c in (0, 1)}, parts=parts)
    return state.where("idx >= since and (label is not null or k is null)").drop("a0", "a1", "x0", "x1", "end")


def state_at(instances: DataFrame, cuts: DataFrame, block_rows: int = BLOCK_ROWS, carried: State | None = None) -> State:
    """States behind row `end` of each (stream, seed, b, since) of `cuts`, as two tables; their `since` is end + 1."""
    key = [*STREAM, "b", (F.col("end") + 1).alias("since")]
    words = _word_rows(instances, cuts, block_rows, carried).groupBy(*key, "word").agg(
        *[F.coalesce(F.sum(f"a{c}"), F.lit(0)).alias(f"m{c}") for c in (0, 1)], *[F.max(f"x{c}").alias(f"u{c}") for c in (0, 1)])
    rows = _trained(instances, cuts, block_rows).select(
        *START, "end", *[of_class(c, F.lit(1)).cast("long").alias(f"n{c}") for c in (0, 1)], *[of_class(c, F.col("t")).alias(f"t{c}") for c in (0, 1)])
    if carried is not None:
        rows = rows.unionByName(carried.docs.join(cuts, START).select(*rows.columns))
    docs = rows.groupBy(*key).agg(
        *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in (0, 1)], *[F.max(f"t{c}").alias(f"t{c}") for c in (0, 1)])
    return State(cut(words, "state-words"), cut(docs, "state-docs"))


def score(instances: DataFrame, segments: DataFrame, block_rows: int = BLOCK_ROWS, carried: State | None = None) -> DataFrame:
    """Score the rows of every track from the state before them.

    Returns stream, seed, seg, blk, idx, label, t, lam, n0, n1, vocab, entries, new_entries, s0, s1,
    pred, where s0 and s1 are ln N_c - lam (t - T_c) + sum of k (ln(aged count + alpha) -
    ln(normaliser)); from the first row that a segment of the track wants on.
    """
    tracks, starts = prepare(instances, segments)
    docs = cut(document_terms(instances, tracks, starts, block_rows, carried), "terms")
    state = running(
        docs, [*STREAM, "seg"], "idx", "blk",
        sums={**{f"n{c}": F.col(f"one{c}") for c in (0, 1)}, "vocab": F.col("new_words"), "entries": F.col("new_entries")},
        maxes={f"last{c}": F.col(f"x{c}") for c in (0, 1)}, decayed={f"r{c}": F.col(f"gain{c}") for c in (0, 1)},
        age=F.expr("lam * (t - origin)")).where("label is not null and idx >= first")
    full = state.selectExpr("*", *[f"greatest(r{c}, 0D) as norm{c}" for c in (0, 1)])
    scored = full.selectExpr("*", *[
        f"ln(n{c}) - lam * (t - last{c}) + "
        f"if(known > 0, term{c} - known * ln(norm{c} + alpha * vocab), 0D) as s{c}" for c in (0, 1)])
    margin = f"{TIE_ABSOLUTE}D + {TIE_RELATIVE}D * (abs(s0) + abs(s1))"
    return scored.selectExpr(
        *STREAM, "seg", "blk", "idx", "label", "t", "lam", "n0", "n1", "vocab", "entries", "new_entries",
        "s0", "s1", f"cast(if(n0 > 0 and n1 > 0, s1 - s0 > {margin}, n1 > n0) as int) as pred")


def predict(instances: DataFrame, segments: DataFrame, block_rows: int = BLOCK_ROWS, carried: State | None = None) -> DataFrame:
    """Score the segments of several models; equal tracks are scored once.

    `segments` also carries `model`. Returns one row per (stream, seed, model, idx).
    """
    segments = with_since(segments)
    scored = score(instances, segments, block_rows, carried)
    owners = blocks_between(segments.select(*STREAM, "model", segment_id().alias("seg"), "lo", "hi"), "lo", "hi", block_rows)
    return scored.join(owners, [*STREAM, "seg", "blk"]).where("idx between lo and hi").drop("lo", "hi", "blk")


def whole_stream(instances: DataFrame, specs: DataFrame) -> DataFrame:
    """One segment per (stream, seed, model) for models that never change.

    `specs` carries model, lam, alpha, and stream where a setting differs by stream.
    """
    extent = instances.groupBy(*STREAM).agg(F.max("idx").alias("hi"))
    cells = extent.join(specs, "stream") if "stream" in specs.columns else extent.crossJoin(specs)
    return cells.select(
        *STREAM, "model", F.lit(0).cast("long").alias("b"), F.col("lam").cast("double"),
        F.col("alpha").cast("double"), F.lit(0).cast("long").alias("lo"), "hi")


def _trained(instances: DataFrame, starts: DataFrame, block_rows: int) -> DataFrame:
    """Rows joined to every start that reads them."""
    rows = instances.withColumn("blk", block_of(F.col("idx"), block_rows))
    return rows.join(blocks_between(starts, "since", "end", block_rows), [*STREAM, "blk"]).where(
        "idx between since and end")


def prepare(instances: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two control tables: tracks, and the starts that they need.

    A track has `first`, the first row to be scored, `end`, the last one, and `origin`, the time of its first row read, as
    zero of its age axis.
    """
    begin = instances.select(*STREAM, F.col("idx").alias("since"), F.col("t").alias("origin"))
    tracks = cut(
        with_since(segments).groupBy(*START, "lam", "alpha").agg(F.min("lo").alias("first"), F.max("hi").alias("end"))
        .withColumn("seg", segment_id()).join(begin, [*STREAM, "since"]), "tracks")
    return tracks, cut(tracks.groupBy(*START).agg(F.max("end").alias("end")), "starts")


def document_terms(instances, tracks, starts, block_rows: int = BLOCK_ROWS, carried: State | None = None) -> DataFrame:
    """Per (track, row): score terms, known tokens, new words and entries, and what the row adds to the state.

    A carried state is a row without a label before the first one. Lines are dealt by blocks of rows, so those of a row meet
    without a second shuffle.
    """
    spans = blocks_between(tracks, "since", "end", block_rows)
    parts = tasks_for(instances.sparkSession, words_read(instances, tracks, block_rows))
    hits = word_state(instances, starts, block_rows, carried, True, parts).join(spans, [*START, "blk"]).where("idx <= end")
    key = [*STREAM, "seg", "lam", "alpha", "origin", "first", "blk", "idx", "t", "label"]
    staged = hits.selectExpr(
        *key, "b", "since", "k", "k is not null and m0 + m1 > 0 as is_known", "if(label = 0, m0, m1) as own",
        *[f"coalesce(m{c} * exp(-lam * (t - u{c})), 0D) as aged{c}" for c in (0, 1)])
    words = staged.selectExpr(
        *key, "b", "since",
        *[f"if(is_known and idx >= first, k * ln(aged{c} + alpha), 0D) as term{c}" for c in (0, 1)],
        "if(is_known, k, 0L) as known", "if(k is null or is_known, 0, 1) as new_words",
        "if(k is not null and own = 0, 1, 0) as new_entries", "if(k is null, 0D, own + k - if(label = 0, aged0, aged1)) as gain")
    terms = ("term0", "term1", "known", "new_words", "new_entries")
    # b and since are part of the key only as the lines were dealt by them
    summed = words.groupBy(*key, "b", "since").agg(*[F.sum(c).alias(c) for c in (*terms, "gain")]).selectExpr(
        *key, *terms, *[f"if(label = {c}, 1L, 0L) as one{c}" for c in (0, 1)], *[f"if(label = {c}, t, null) as x{c}" for c in (0, 1)],
        *[f"if(label = {c}, gain, 0D) as gain{c}" for c in (0, 1)])
    return summed if carried is None else summed.unionByName(_carried_rows(tracks, carried, block_rows).select(*summed.columns))


def _carried_rows(tracks: DataFrame, carried: State, block_rows: int) -> DataFrame:
    """The carried state of each track: what its words weigh at the origin under the track's rate."""
    key = [*STREAM, "seg", "lam", "alpha", "origin", "first", "since"]
    of_words = carried.words.join(tracks, START).groupBy(*STREAM, "seg").agg(
        F.count(F.lit(1)).alias("new_words"), F.sum(F.expr("if(m0 > 0, 1, 0) + if(m1 > 0, 1, 0)")).alias("new_entries"),
        *[F.sum(F.expr(f"coalesce(m{c} * exp(-lam * (origin - u{c})), 0D)")).alias(f"gain{c}") for c in (0, 1)])
    rows = carried.docs.join(tracks, START).select(*key, "n0", "n1", "t0", "t1").join(of_words, [*STREAM, "seg"], "left")
    before = F.col("since") - 1
    return rows.select(
        *key, before.alias("idx"), block_of(before, block_rows).alias("blk"), F.col("origin").alias("t"), F.lit(None).cast("int").alias("label"),
        *[F.lit(0.0).alias(f"term{c}") for c in (0, 1)], F.lit(0).cast("long").alias("known"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("new_words", "new_entries")],
        *[F.col(f"n{c}").alias(f"one{c}") for c in (0, 1)], *[F.col(f"t{c}").alias(f"x{c}") for c in (0, 1)],
        *[F.coalesce(f"gain{c}", F.lit(0.0)).alias(f"gain{c}") for c in (0, 1)])
