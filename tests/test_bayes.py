import math
import random
from collections import Counter

from pyspark.sql import functions as F

from driftloom.operators import bayes, prefix

SEGMENTS = [  # model, b, lam, alpha, lo, hi: rate changes, rebuilds, and a whole stream
    ("m", 0, 0.3, 1.0, 0, 99), ("m", 0, 0.9, 1.0, 100, 199), ("m", 120, 0.9, 1.0, 200, 299),
    ("m", 120, 0.0, 1.0, 300, 349), ("m", 300, 5.0, 0.5, 350, 399), ("whole", 0, 0.0, 1.0, 0, 399)]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        words = [rng.choice(["p", "n"][y:] + ["s"]) + str(rng.randint(0, 12)) for _ in range(rng.randint(0, 6))]
        rows.append((words, y, i * 0.6 + 0.2 * (i % 3)))
    return rows


def literal_scores(rows, b, lam, alpha, at):
    """The published formulas, evaluated from scratch on rows b..at-1."""
    n, last, words = [0, 0], [0.0, 0.0], [{}, {}]
    for tokens, y, t in rows[b:at]:
        n[y] += 1
        last[y] = t
        for w, k in Counter(tokens).items():
            words[y][w] = (words[y].get(w, (0, 0))[0] + k, t)
    tokens, _, t = rows[at]
    vocab = set(words[0]) | set(words[1])
    entries = len(words[0]) + len(words[1])
    if not (n[0] and n[1]):
        return None, int(n[1] > n[0]), len(vocab), entries
    scores = []
    for c in (0, 1):
        s = math.log(n[c]) - lam * (t - last[c])
        norm = sum(k * math.exp(-lam * (t - at_)) for k, at_ in words[c].values()) + alpha * len(vocab)
        for w, k in Counter(x for x in tokens if x in vocab).items():
            count, at_ = words[c].get(w, (0, t))
            s += k * (math.log(count * math.exp(-lam * (t - at_)) + alpha) - math.log(norm))
        scores.append(s)
    return scores, int(scores[1] - scores[0] > 1e-9), len(vocab), entries


def test_scores_equal_the_literal_formulas(spark, instances_of):
    rows = corpus()
    segments = spark.createDataFrame(
        [("s", 0, *s) for s in SEGMENTS],
        "stream string, seed int, model string, b long, lam double, alpha double, lo long, hi long")
    got = {(r.model, r.idx): r for r in bayes.predict(instances_of(rows), segments, block_rows=64).collect()}
    assert len(got) == 800
    for model, b, lam, alpha, lo, hi in SEGMENTS:
        for i in range(lo, hi + 1):
            scores, pred, vocab, entries = literal_scores(rows, b, lam, alpha, i)
            r = got[(model, i)]
            assert (r.pred, r.vocab, r.entries) == (pred, vocab, entries), (model, i)
            if scores:
                for mine, want in zip((r.s0, r.s1), scores):
                    assert abs(mine - want) <= 1e-9 * max(1, abs(want)), (model, i)


def test_majority_tie_is_zero(spark, instances_of):
    rows = [(["x"], 1, 0), (["x"], 1, 1), (["x"], 0, 2), ([], 0, 3), ([], 0, 4), ([], 0, 5)]
    got = [r.pred for r in bayes.majority(instances_of(rows), 2).orderBy("idx").collect()]
    assert got == [0, 1, 1, 1, 0, 0]


def test_ageing_forgets_a_class_that_stops(spark, instances_of):
    rows = [(["good", "day"], 1, float(i)) for i in range(200)]
    rows += [(["good", "day"], 0, 200.0 + i) for i in range(21)]
    segments = spark.createDataFrame(
        [("s", 0, "ageing", 0, 0.2, 1.0, 0, 220), ("s", 0, "accumulative", 0, 0.0, 1.0, 0, 220)],
        "stream string, seed int, model string, b long, lam double, alpha double, lo long, hi long")
    got = {r.model: r.pred for r in bayes.predict(instances_of(rows), segments, 64).where("idx = 220").collect()}
    assert got == {"ageing": 0, "accumulative": 1}


def test_words_are_dealt_over_as_many_tasks_as_their_number_asks(spark, instances_of, monkeypatch):
    """Shuffled bytes tell little of the memory of a task, so the number of words sets the number of tasks; the terms of a row
    are summed where its words lie."""
    inst = instances_of(corpus())
    segments = bayes.with_since(spark.createDataFrame(
        [("s", 0, *s) for s in SEGMENTS], "stream string, seed int, model string, b long, lam double, alpha double, lo long, hi long"))
    tracks, starts = bayes.prepare(inst, segments)
    wanted = sorted(map(str, bayes.document_terms(inst, tracks, starts, 16).select("seg", "idx", "known", "new_words", "new_entries").collect()))
    monkeypatch.setattr(prefix, "TASK_ROWS", 100)
    terms = bayes.document_terms(inst, tracks, starts, 16)
    assert sorted(map(str, terms.select("seg", "idx", "known", "new_words", "new_entries").collect())) == wanted
    lines = bayes.words_read(inst, tracks, 16)
    assert lines > 4000
    tasks = terms.groupBy(F.spark_partition_id()).count().count()
    assert terms.rdd.getNumPartitions() == -(-lines // 100) and tasks > 20
