"""Log-probabilities of texts under a word n-gram model, scored as a weighted backoff automaton.

The learned documents' n-grams are the states and arcs: from the state of the words read, a token follows its arc if that
n-gram was seen, with weight (n + mu * lower) / (c + mu), and otherwise the failure arc with weight mu / (c + mu) to the
state of one word less, down to the root, whose arcs are the words' smoothed shares (n + 1) / (N + V + 1), and one share for all
unseen words. c is the count of the state's words, n that of the n-gram, and mu the strength of the lower order. The
weights of a state and its failure arcs add up to one. A text is read once from left to right, from the start state; its
log10 weights add up.

The states are spread over shards by hash, and each block of documents is given the arcs that its texts can follow (see
blocks.py), so no task holds the whole automaton, whatever its size. Counts are exact and over all learned documents.

Null text is empty and scores the end alone; ids may repeat or be null (a null id is learned from unless fold 0 is held
out); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import oracles
from driftloom.llm.base import cut, fold, query, table
from driftloom.llm.blocks import Block, answers, asks, documents, shards_for, totals, with_answers, write_blocks

ORDER, STRENGTH = 2, 100.0
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def traverse(block: Block, counts: dict[int, np.ndarray], texts: int, total: int, words: int, order: int, mu: float) -> np.ndarray:
    """Weight of each token's path (its arc and the failure arcs above it); the state is carried from token to token."""
    weight = ((counts[1] + 1.0) / (total + words + 1.0))[block.number]
    arc = counts[1][block.number].astype(np.float64)
    for n, (_, back) in enumerate(block.grams(order)[1:], 2):
        # the state that a token starts from is where the arc of the token before it ended
        state = np.empty(len(arc))
        state[1:] = arc[:-1]
        state[block.first[:-1]] = texts
        arc = counts[n][back].astype(np.float64)
        weight = (arc + mu * weight) / (state + mu)
    return weight


def score_documents(docs: DataFrame, folds: int, held: int, order: int = ORDER, mu: float = STRENGTH) -> DataFrame:
    """Scores of all documents by a model of those whose fold is not `held`."""
    rows = documents(docs, fold(F.col("doc_id"), folds) != held)
    written = cut(write_blocks(rows), "ngram-blocks")
    answered = cut(answers(asks(written, order, shards_for(docs))), "ngram-counts")
    n_tokens, n_words = totals(answered).get(1, (0, 0))
    texts = rows.where("learned").count()

    def score(block: Block, counts: dict[int, np.ndarray]) -> pd.DataFrame:
        own = counts[1][block.number]
        base = np.log10((own + 1.0) / (n_tokens + n_words + 1.0))
        model = np.log10(traverse(block, counts, texts, n_tokens, n_words, order, mu))
        at = block.first[:-1]
        out = pd.DataFrame({
            "doc_id": pd.array(block.doc_id, dtype="Int64"), "held_out": ~block.learned, "n_tokens": np.diff(block.first),
            "n_known": np.add.reduceat((own > 0).astype(np.int64), at), "train_tokens": n_tokens,
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(model, at)})
        out.loc[block.no_id, "doc_id"] = pd.NA
        return out

    return with_answers(written, answered, score, SCORED)


@query("op9_lm_scoring", oracles.scoring(STRENGTH))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), folds=7, held=2)
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
