"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learned vector of its hash bucket beside the mean of the vectors of its byte n-grams (the word's
edges included), so unseen words of a known shape are recognised. Two gated recurrences of opposite direction run over
windows of WINDOW words that overlap by half; attention weighs their states, and the pooled state gives the window's
logit. A document's score is that of its worst window, over all windows of its whole text.

The network is fitted on the driver, or by the pipeline in one task, to a bounded sample: at most SAMPLE labelled documents of each class with at most
SAMPLE_CHARS characters, in the order of a hash of the id. Training is multiple-instance: each document is represented by
the window that scores highest at the time. Scoring has no bound: every window of every text, in Arrow batches, with the
network (about 1.5 MB, fixed) sent along. Scores depend on the text alone.

Null text counts as empty and gets the score of the empty window; a null doc_id is scored and in fold 0; without labels of
both classes the network stays at its start and every score is 0.5. Other columns are not read by the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import text as tx
from driftloom.llm.base import fold, query, table

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS, WIDTH, HIDDEN = 15, 15, 6, 8
SAMPLE, SAMPLE_CHARS = 900, 20_000
EPOCHS, BATCH = 6, 96
THRESHOLD = 0.7
WEIGHTS = "name string, weights binary"


def word_inputs(words: tx.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: (bucket, gram buckets, first gram of each), and each word's place; grams are of 3 to 5 bytes."""
    known, at, back = np.unique(h, return_index=True, return_inverse=True)
    start, length = words.starts[at], words.ends[at] - words.starts[at]
    # every distinct word once, with an edge on both sides
    room = length + 2
    end = np.cumsum(room)
    padded = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    padded[tx.ragged(end - room + 1, length)] = words.data[tx.ragged(start, length)]
    codes = padded.astype(np.uint64)
    each = []
    for n in (3, 4, 5):
        run = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
        for j in range(n):
            run = run * np.uint64(257) + codes[j:j + len(run)] + np.uint64(1)
        count = np.maximum(0, room - n + 1)
        each.append((tx.mixed(run + np.uint64(n))[tx.ragged(end - room, count)] & np.uint64((1 << GRAM_BITS) - 1), count))
    total = sum(c for _, c in each) if each else np.zeros(0, dtype=np.int64)
    grams = np.empty(int(total.sum()), dtype=np.int64)
    shift = np.cumsum(total) - total
    for bucket, count in each:
        grams[tx.ragged(shift, count)] = bucket
        shift = shift + count
    first = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    return (known & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), grams, first, back, known


def windows_of(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all windows; the last one of a long text ends with it; an empty text has an empty one."""
    counts = words.counts()
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    place = np.minimum(tx.ragged(np.zeros(len(n), dtype=np.int64), n) * STRIDE, np.maximum(0, counts - WINDOW)[doc])
    return doc, words.first[doc] + place, np.minimum(WINDOW, counts)[doc]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by their place."""
    return np.stack([np.bincount(at, weights=v, minlength=n) for v in values.T], axis=1).astype(np.float32)


class Network:
    """Weights by name; all float32."""

    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "word": draw(1 << WORD_BITS, WIDTH, scale=0.05), "gram": draw(1 << GRAM_BITS, WIDTH, scale=0.05),
            "look": draw(2 * HIDDEN, scale=0.1), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, dtype=np.float32),
        }
        for side in ("f", "b"):
            self.w["in_" + side] = draw(2 * WIDTH, 3 * HIDDEN, scale=0.4)
            self.w["at_" + side] = np.zeros(3 * HIDDEN, dtype=np.float32)
            self.w["re_" + side] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)

    @classmethod
    def of(cls, weights: dict[str, bytes]) -> Network:
        network = cls()
        network.w = {k: np.frombuffer(weights[k], dtype=np.float32).reshape(v.shape) for k, v in network.w.items()}
        return network

    def features(self, bucket: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input of each distinct word, and one of zeros for a place without a word."""
        out = np.zeros((len(bucket) + 1, 2 * WIDTH), dtype=np.float32)
        if len(bucket):
            out[:-1, :WIDTH] = self.w["word"][bucket]
            count = np.diff(first)
            sums = np.add.reduceat(self.w["gram"][grams], np.minimum(first[:-1], max(0, len(grams) - 1)), axis=0) if len(grams) else 0.0
            out[:-1, WIDTH:] = sums / np.maximum(1, count)[:, None]
            out[:-1, WIDTH:][count == 0] = 0
        return out

    def recur(self, x: np.ndarray, side: str, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; x is (words, windows, 3 * HIDDEN), real marks the places that hold a word."""
        steps, n, _ = x.shape
        u, h = self.w["re_" + side], np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.empty((steps, n, HIDDEN), dtype=np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = h @ u
            gates = sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
            step = (1 - z) * real[t] * (new - h)
            if keep is not None:
                keep.append((t, h, z, r, new, a[:, 2 * HIDDEN:]))
            h = h + step
            out[t] = h
        return out

    def logits(self, place: np.ndarray, features: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; place is (words, windows), the number of each word among the features."""
        real = (place < len(features) - 1).astype(np.float32)[:, :, None]
        states = []
        for side in ("f", "b"):
            steps = [] if keep is not None else None
            states.append(self.recur((features @ self.w["in_" + side] + self.w["at_" + side])[place], side, real, steps))
            if keep is not None:
                keep[side] = steps
        both = np.concatenate(states, axis=2)
        look = np.where(real[:, :, 0] > 0, both @ self.w["look"], np.float32(-30))
        weight = np.exp(look - look.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (both * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"real": real, "both": both, "weight": weight, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["bias"]

    def gradients(self, place, features, bucket, grams, first, error) -> dict[str, np.ndarray]:
        """Gradients for d loss / d logit = error(logits)."""
        keep: dict = {}
        logits = self.logits(place, features, keep)
        d = error(logits)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        both, weight, pooled, real = keep["both"], keep["weight"], keep["pooled"], keep["real"]
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
        d_pooled = d[:, None] * self.w["out"]
        d_look = weight * ((both * d_pooled).sum(axis=2) - (pooled * d_pooled).sum(axis=1))
        d_both = weight[:, :, None] * d_pooled + d_look[:, :, None] * self.w["look"]
        g["look"] = np.tensordot(d_look, both, axes=([0, 1], [0, 1]))
        d_features = np.zeros_like(features)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u = self.w["re_" + side]
            d_x = np.zeros((*place.shape, 3 * HIDDEN), dtype=np.float32)
            carry = np.zeros((place.shape[1], HIDDEN), dtype=np.float32)
            for t, h, z, r, new, a in reversed(keep[side]):
                carry = carry + d_both[t, :, part]
                d_step = carry * real[t]
                d_new = d_step * (1 - z) * (1 - new * new)
                d_z = d_step * (h - new) * z * (1 - z)
                d_r = d_new * a * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g["re_" + side] += h.T @ d_a
                carry = carry - d_step * (1 - z) + d_a @ u.T
            flat = summed(place.ravel(), d_x.reshape(-1, 3 * HIDDEN), len(features))
            g["in_" + side], g["at_" + side] = features.T @ flat, flat.sum(axis=0)
            d_features += flat @ self.w["in_" + side].T
        g["word"] = summed(bucket, d_features[:-1, :WIDTH], 1 << WORD_BITS)
        count = np.maximum(1, np.diff(first))
        g["gram"] = summed(grams, np.repeat(d_features[:-1, WIDTH:] / count[:, None], np.diff(first), axis=0), 1 << GRAM_BITS)
        return g


def worst_windows(network: Network, texts: pa.Array, rows: int = 4096) -> np.ndarray:
    """Highest logit over the windows of each text."""
    w = tx.split(texts, tx.LETTERS)
    bucket, grams, first, back, _ = word_inputs(w, tx.hashes(w))
    features = network.features(bucket, grams, first)
    doc, start, length = windows_of(w)
    best = np.full(len(w.first) - 1, -np.inf, dtype=np.float32)
    back = np.append(back, len(bucket))
    steps = np.arange(WINDOW)[:, None]
    for i in range(0, len(doc), rows):
        s, n = start[i:i + rows], length[i:i + rows]
        place = np.where(steps < n, back[np.minimum(s + steps, len(back) - 1)], len(bucket))
        np.maximum.at(best, doc[i:i + rows], network.logits(place, features))
    return best


def fit(texts: list[str], toxic: np.ndarray, seed: int = 11) -> Network:
    """The network fitted to whole texts; see the top of the module."""
    network, random = Network(seed), np.random.default_rng(seed)
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        network.w["out"][:] = 0
        return network
    w = tx.split(pa.array(texts, pa.string()), tx.LETTERS)
    bucket, grams, first, back, _ = word_inputs(w, tx.hashes(w))
    # start: the first component of a word and of a gram is its weight of evidence by documents
    for name, bits in (("word", WORD_BITS), ("gram", GRAM_BITS)):
        bad, good = np.zeros(1 << bits), np.zeros(1 << bits)
        for d, is_toxic in enumerate(toxic):
            own = np.unique(back[w.first[d]:w.first[d + 1]])
            values = bucket[own] if name == "word" else grams[tx.ragged(first[:-1][own], np.diff(first)[own])]
            (bad if is_toxic else good)[np.unique(values)] += 1
        network.w[name][:, 0] = 0.4 * (np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / ((~toxic).sum() + 2)))
    doc, start, length = windows_of(w)
    places = np.append(back, len(bucket))
    evidence = np.append(network.w["word"][bucket, 0], -9.0)
    steps = np.arange(WINDOW)[:, None]

    def place_of(which: np.ndarray) -> np.ndarray:
        return np.where(steps < length[which], places[np.minimum(start[which] + steps, len(places) - 1)], len(bucket))

    mean = {k: np.zeros_like(v) for k, v in network.w.items()}
    square = {k: np.zeros_like(v) for k, v in network.w.items()}
    turn, rate = 0, 0.02
    for epoch in range(EPOCHS):
        features = network.features(bucket, grams, first)
        if epoch == 0:
            scores = np.concatenate([evidence[place_of(np.arange(i, min(i + 2048, len(doc))))].max(axis=0) for i in range(0, len(doc), 2048)])
        else:
            scores = np.concatenate([network.logits(place_of(np.arange(i, min(i + 2048, len(doc)))), features) for i in range(0, len(doc), 2048)])
        order = np.lexsort((-scores, doc))
        top = order[np.searchsorted(doc[order], np.arange(len(toxic)))]
        other = np.searchsorted(doc, np.arange(len(toxic))) + (random.random(len(toxic)) * np.bincount(doc, minlength=len(toxic))).astype(np.int64)
        # every document by its worst window; clean ones by a random one too
        which = np.concatenate([top, other[~toxic]])
        label = np.concatenate([toxic, np.zeros((~toxic).sum(), dtype=bool)]).astype(np.float32)
        balance = np.where(label > 0, len(label) / (2 * label.sum()), len(label) / (2 * (len(label) - label.sum()))).astype(np.float32)
        mixed = random.permutation(len(which))
        for i in range(0, len(mixed), BATCH):
            some = mixed[i:i + BATCH]
            place = place_of(which[some])
            used, inner = np.unique(np.append(place.ravel(), len(bucket)), return_inverse=True)
            own = used[:-1]
            count = np.diff(first)[own]
            own_grams = grams[tx.ragged(first[:-1][own], count)]
            own_first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            inner = inner[:-1].reshape(place.shape)
            y, b = label[some], balance[some]
            g = network.gradients(inner, network.features(bucket[own], own_grams, own_first), bucket[own], own_grams, own_first,
                                  lambda z, y=y, b=b: ((sigmoid(z) - y) * b / len(y)).astype(np.float32))
            turn += 1
            for k in network.w:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] * g[k] - square[k])
                network.w[k] -= rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-6)
        rate *= 0.85
    return network


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> DataFrame:
    """The bounded sample (doc_id, text, toxic) of labelled rows outside the held-out fold."""
    open_rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), folds) != held).distinct()
    chosen = [open_rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE * (1 if y else 2)) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # 3 * SAMPLE ids at most, and one text for each: that with the least hash
    labelled = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id")
    one = labelled.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", "x.text", "toxic")


def fitted(rows: pd.DataFrame) -> Network:
    rows = rows.sort_values(["doc_id", "text"])
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy() == 1)


def fit_on(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Network:
    """Fit to the bounded sample of labelled rows outside the held-out fold."""
    return fitted(sample(docs, labels, folds, held).toPandas())


def fit_in_task(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Network:
    """`fit_on` in a task: the driver gets the weights only and keeps none of the memory that fitting takes."""
    rows = sample(docs, labels, folds, held).groupBy(F.lit(1).alias("all")).applyInPandas(weights_of, WEIGHTS).collect()
    return Network.of({r["name"]: r["weights"] for r in rows}) if rows else fit([], np.zeros(0, dtype=bool))


def weights_of(rows: pd.DataFrame) -> pd.DataFrame:
    w = fitted(rows).w
    return pd.DataFrame({"name": list(w), "weights": [v.tobytes() for v in w.values()]})


def scorer(network: Network):
    """Column function: text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string(), from_pandas=True)], names=["text"])
            logits = [worst_windows(network, p.column("text")) for p in tx.parts(iter([batch]), limit=2 << 20)]
            yield pd.Series(sigmoid(np.concatenate([np.empty(0, dtype=np.float32), *logits]).astype(np.float64)))

    return score


def scored(docs: DataFrame, network: Network) -> Column:
    return scorer(network)(F.col("text").cast("string"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` that score below the threshold."""
    return docs.where(scored(docs, fit_on(docs, labels)) < threshold)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), scored(docs, network).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
