"""Scenario streams with known drift points, drawn from topic pools of a corpus.

All scenarios and seeds are built in one job: stream and seed are columns, not loops.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import clock
from driftloom.functions.text import mentions_topic
from driftloom.operators.sampling import draw_key, drawn_ordinal, ordinal_by_index, uniform, usable_rows
from driftloom.session import cut

# Topic keywords and the shape of the scenarios.
TOPIC_A = ["boss", "class", "classes", "college", "coursework", "essay", "exam", "exams", "finals",
           "homework", "interview", "job", "lecture", "meeting", "office", "revision", "school",
           "shift", "study", "studying", "teacher", "work", "working"]
TOPIC_B = ["album", "band", "cinema", "concert", "dvd", "film", "gig", "listening", "lyrics",
           "movie", "movies", "music", "playlist", "radio", "singing", "song", "songs", "tickets",
           "trailer"]
GRADUAL_WIDTH = 0.25
FLIP_TOPIC_SHARE = 0.5
PRIOR_AFTER = 0.10
SCENARIOS = ("s_sudden", "s_gradual", "s_recurring", "s_label_flip", "s_prior_shift", "s_label_flip_topic")
STREAM = ["stream", "seed"]


def topic_pools(corpus: DataFrame, topic_a=TOPIC_A, topic_b=TOPIC_B) -> DataFrame:
    """Usable rows with their pool: A only, B only, or general (neither)."""
    rows = usable_rows(corpus)
    in_a, in_b = mentions_topic(F.col("tokens"), topic_a), mentions_topic(F.col("tokens"), topic_b)
    pool = F.when(in_a & ~in_b, "A").when(in_b & ~in_a, "B").when(~in_a & ~in_b, "general")
    return rows.withColumn("pool", pool).where(F.col("pool").isNotNull())


def drift_points(name: str, n: int) -> dict:
    """Drift points, windows and flip rule of a scenario of n rows."""
    half, quarter = n // 2, n // 4
    width = int(n * GRADUAL_WIDTH)
    if name == "s_gradual":
        start, end = half - width // 2, half + width // 2
        return {"drift_points": [start], "drift_windows": [[start, end]], "flip": None}
    if name == "s_recurring":
        return {"drift_points": [quarter, 2 * quarter, 3 * quarter], "drift_windows": [], "flip": None}
    flip = {"s_label_flip": {"topic": None, "from_idx": half},
            "s_label_flip_topic": {"topic": "A", "from_idx": half}}.get(name)
    return {"drift_points": [half], "drift_windows": [], "flip": flip}


def drifts(spark: SparkSession, names, n: int, seeds) -> DataFrame:
    rows = []
    for name in names:
        meta = drift_points(name, n)
        ends = {s: e for s, e in meta["drift_windows"]}
        rows += [(name, seed, p, ends.get(p, p)) for seed in seeds for p in meta["drift_points"]]
    return spark.createDataFrame(rows, "stream string, seed int, p long, e long")


def slots(spark: SparkSession, names, n: int, seeds) -> DataFrame:
    """(stream, seed, idx, topic, class): what each position of each stream must hold."""
    cells = F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(k).alias("seed")) for s in names for k in seeds])
    grid = spark.range(n).select(F.col("id").alias("idx"), F.inline(cells))
    half, quarter, width = n // 2, n // 4, int(n * GRADUAL_WIDTH)
    start, end = half - width // 2, half + width // 2
    idx, stream = F.col("idx"), F.col("stream")
    share_b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (idx - start) / F.lit(float(max(end - start, 1)))))
    turn = F.least(F.floor(idx / max(quarter, 1)), F.lit(3))
    topic = (
        F.when(stream == "s_sudden", F.when(idx < half, "A").otherwise("B"))
        .when(stream == "s_gradual", F.when(uniform(stream, F.col("seed"), F.lit("topic"), idx) < share_b, "B").otherwise("A"))
        .when(stream == "s_recurring", F.when(turn % 2 == 0, "A").otherwise("B"))
        .otherwise("general")
    )
    plain = grid.withColumn("topic", topic)
    # Exactly half of the topic-flip stream is topic A, at random positions.
    mixed = drawn_ordinal(
        plain.where("stream = 's_label_flip_topic'"), STREAM,
        draw_key(stream, F.col("seed"), F.lit("mix"), idx), "_mix")
    mixed = mixed.withColumn(
        "topic", F.when(F.col("_mix") < round(n * FLIP_TOPIC_SHARE), "A").otherwise("general")).drop("_mix")
    topics = plain.where("stream <> 's_label_flip_topic'").unionByName(mixed)

    # Positive share 1/2 within each topic; the prior shift has its own share after the middle.
    late = (stream == "s_prior_shift") & (idx >= half)
    parts = topics.withColumn("_part", F.when(late, "late").otherwise(F.col("topic")))
    group = [*STREAM, "_part"]
    sizes = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = drawn_ordinal(parts, group, draw_key(stream, F.col("seed"), F.lit("class"), idx), "_rank")
    share = F.when(F.col("_part") == "late", PRIOR_AFTER).otherwise(0.5)
    return ranked.join(sizes, group).withColumn(
        "class", (F.col("_rank") < F.bround(F.col("_size") * share)).cast("int")
    ).select(*STREAM, "idx", "topic", "class")


def draw(pools: DataFrame, wanted: DataFrame, seeds) -> DataFrame:
    """Fill each slot with a pool row, without replacement within a stream.

    Slots are numbered per (stream, seed, topic, class) in stream order, pool rows per (seed,
    pool, class) in draw order; equal numbers meet in one equi-join. Empty slots stay, with
    NULL ids, so an exhausted pool is visible.
    """
    numbered = drawn_ordinal(
        pools.select("id", "ts", "label", "user", "text", "pool",
                     F.explode(F.array(*[F.lit(k) for k in seeds])).alias("seed")),
        ["seed", "pool", "label"], draw_key(F.col("seed"), F.col("id")))
    source = numbered.select(
        "seed", F.col("pool").alias("topic"), F.col("label").cast("int").alias("class"), "ordinal",
        "id", F.col("ts").alias("orig_ts"), F.col("label").alias("orig_label"), "user", "text")
    places = ordinal_by_index(wanted, [*STREAM, "topic", "class"])
    return places.join(source, ["seed", "topic", "class", "ordinal"], "left").drop("ordinal")


def exhausted(drawn: DataFrame) -> DataFrame:
    """Slots that no pool row was left for, per (stream, seed, topic, class)."""
    return drawn.where(F.col("id").isNull()).groupBy(*STREAM, "topic", "class").agg(
        F.count(F.lit(1)).alias("missing"))


def assemble(drawn: DataFrame, n: int) -> DataFrame:
    """Scenario rows: new clock and labels, originals kept."""
    half = n // 2
    flips: Column = F.lit(False)
    for name in SCENARIOS:
        rule = drift_points(name, n)["flip"]
        if rule:
            hit = (F.col("stream") == name) & (F.col("idx") >= half)
            if rule["topic"]:
                hit = hit & (F.col("topic") == rule["topic"])
            flips = flips | hit
    return drawn.select(
        *STREAM, "idx", "id", clock.synthetic_timestamp(F.col("idx")).alias("ts"),
        clock.flip_label(F.col("orig_label"), flips).alias("label"), "user", "text", "topic",
        F.col("orig_label").cast("byte").alias("orig_label"), "orig_ts")


def build(corpus: DataFrame, n: int, seeds, names=SCENARIOS, topic_a=TOPIC_A, topic_b=TOPIC_B) -> DataFrame:
    """All scenario streams; refuses a corpus whose pools do not fill every slot."""
    wanted = slots(corpus.sparkSession, names, n, seeds)
    drawn = cut(draw(topic_pools(corpus, topic_a, topic_b), wanted, seeds), "drawn")
    short = exhausted(drawn).limit(5).collect()
    if short:
        raise ValueError("pools too small: " + ", ".join(f"{r['stream']} seed {r['seed']} {r['topic']}/{r['class']}: {r['missing']}" for r in short))
    return assemble(drawn, n)


def sidecar(name: str, n: int, seed: int, positive_share: float) -> str:
    """Drift metadata of one scenario stream as JSON text."""
    meta = drift_points(name, n)
    return json.dumps({
        "stream": name, "n": n, "positive_share": round(positive_share, 4), **meta,
        "seed": seed, "topics": {"A": TOPIC_A, "B": TOPIC_B}})
