"""Enhanced model: vocabulary detector plus ADWIN on the model's own errors.

The errors depend on the model and the model on the errors, so cells advance in rounds. What the
vocabulary does is known ahead, so a round first plans the segments of the open rows of every cell
as if no error signal came, scores them with the set-based plan, and runs the reactor over the error
bits. The rows up to the first one after which the cell is not as planned are kept, and the next
round goes on behind it. Only error signals that change something thus cost a round, whatever the
strategy of the vocabulary channel does; a cell that goes as planned looks further in the next round.

A round does not go back: what the kept rows have taught (counts and last times) is a state table at
the cut, and the next round reads the rows behind it only. A rebuilt model reads the rows of its
buffer once more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import bayes, vocabulary
from driftloom.operators.adwin import unpack
from driftloom.operators.fold import ordered_fold
from driftloom.operators.prefix import BLOCK_ROWS
from driftloom.operators.reactions import Cell
from driftloom.plans.informed import extent_of
from driftloom.session import cut

CELL = ["stream", "seed", "model"]
#: Windows that a cell looks ahead at first; four times as far in each round without an unplanned change.
LOOK_WINDOWS, FURTHER = 8, 4
#: After one it looks twice as far as the round got, and so many rows at least, which cost little beside a round's own steps.
AFTER, AFTER_ROWS = 2, 250_000
PLAN_SCHEMA = "stream string, seed int, model string, b long, lam double, lo long, hi long"
OUTCOME_SCHEMA = (
    "stream string, seed int, model string, what string, idx long, detector string, kind string, "
    "acted boolean, rebuild_size long, width long, error_rate double, lam double, b long, "
    "next_row long, look long, memory string"
)
OUTCOME_COLUMNS = [f.split()[0] for f in OUTCOME_SCHEMA.split(", ")]


@dataclass
class EnhancedRun:
    predictions: DataFrame
    events: DataFrame
    rates: DataFrame
    checks: DataFrame
    rounds: int


def run(instances: DataFrame, specs: DataFrame, block_rows: int = BLOCK_ROWS) -> EnhancedRun:
    """Run every enhanced cell to the end of its stream.

    `instances` is a table with word bags; `specs` has one row per (stream, seed, model).
    """
    specs = cut(specs, "specs")
    watched = specs.where("fusion <> 'adwin_only'")
    seen = cut(vocabulary.window_words(instances, watched), "window-words")
    checks = cut(vocabulary.detect(instances, watched, seen), "checks")
    extent = extent_of(instances)

    state = cut(specs.join(extent, ["stream", "seed"]).select(
        *CELL, "n", "w", "alpha", F.to_json(F.struct(*[c for c in specs.columns if c not in CELL])).alias("spec"),
        F.lit(0).cast("long").alias("next_row"), F.lit(0).cast("long").alias("b"), "lam",
        (F.col("w") * LOOK_WINDOWS).alias("look"), F.lit("").alias("memory")), "cells")
    moving = ("next_row", "b", "lam", "look", "memory")
    fixed = [c for c in state.columns if c not in moving]
    kept, outcomes, rounds, carried = [], [], 0, None
    while True:
        open_cells = cut(state.where("next_row < n").withColumn("hi", F.least(F.col("next_row") + F.col("look"), F.col("n")) - 1), "open-cells")
        rounds += 1
        due = cut(checks.join(open_cells.select(*CELL, "next_row", "hi"), CELL).where("idx between next_row and hi").select(
            *CELL, F.col("idx").alias("pos"), "signal", "train_from"), "due")
        planned = cut(_plan(due, open_cells), "planned")
        own = open_cells.select(*CELL, "alpha", F.col("b").alias("_b"), F.col("next_row").alias("_since"))
        # the model at hand goes on from its carried state, a planned rebuild reads its rows
        spans = cut(planned.join(own, CELL).withColumn("since", F.expr("if(b = _b, _since, b)")).drop("_b", "_since"), "spans")
        predictions = cut(bayes.predict(instances, spans, block_rows, carried), "tentative")
        outcome = cut(_react(predictions, due, planned, open_cells), "outcome")
        outcomes.append(outcome)
        moved = outcome.where("what = 'state'").select(*CELL, *moving)
        kept.append(predictions.join(moved.select(*CELL, "next_row"), CELL).where("idx < next_row").drop("next_row"))
        state = cut(open_cells.select(*fixed).join(moved, CELL).select(*state.columns), "cells")
        still = state.where("next_row < n")
        if still.isEmpty():
            break
        # cells that continue the model they had go on from its state, others from the rows of their new one
        behind = still.join(own, CELL).select("stream", "seed", "b", F.expr("if(b = _b, _since, b)").alias("since"), (F.col("next_row") - 1).alias("end"))
        carried = bayes.state_at(instances, cut(behind.distinct(), "state-cuts"), block_rows, carried)
    log = reduce(DataFrame.unionByName, outcomes)
    rates = log.where("what = 'rate'").select(*CELL, "idx", "lam").unionByName(
        specs.select(*CELL, F.lit(0).cast("long").alias("idx"), "lam"))
    return EnhancedRun(
        predictions=reduce(DataFrame.unionByName, kept),
        events=log.where("what = 'event'").select(
            *CELL, "idx", "detector", "kind", "acted", "rebuild_size", "width", "error_rate"),
        rates=rates, checks=checks, rounds=rounds)


def _heads(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL, F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("turn"), "spec", "b", "lam", "look", "memory", "w", "next_row", "hi")


def _cell_of(row) -> Cell:
    return Cell(json.loads(row.spec), int(row.b), float(row.lam), json.loads(row.memory) if row.memory else None)


def _plan(due: DataFrame, cells: DataFrame) -> DataFrame:
    """Segments of the open rows of each cell if no error signal comes: the checks run through a copy of the cell."""
    rows = due.withColumn("turn", F.lit(2)).unionByName(_heads(cells), allowMissingColumns=True)
    return ordered_fold(rows, CELL, ["pos", "turn"], _plan_step, PLAN_SCHEMA)


def _plan_step():
    cell: dict = {}
    found: list = []

    def note(at: int) -> None:
        """The cell as it is from row `at` on."""
        reactor = cell["reactor"]
        if found and (found[-1][3], found[-1][4]) == (reactor.start, reactor.lam):
            return
        if found and found[-1][5] == at:
            found.pop()
        found.append([*cell["key"], reactor.start, reactor.lam, at])

    def upto(pos: int) -> None:
        """The end of a fast period, if it comes by this row."""
        fast = cell["reactor"].fast
        if fast is not None and fast <= pos:
            cell["reactor"].end_fast(fast)
            note(fast + 1)

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        for row in batch.itertuples(index=False):
            if row.turn == 0:
                cell.update(key=(row.stream, row.seed, row.model), hi=int(row.hi), reactor=_cell_of(row))
                note(int(row.next_row))
            else:
                upto(int(row.pos))
                cell["reactor"].check(int(row.pos), row.signal, row.train_from)
                note(int(row.pos) + 1)
        return pd.DataFrame([], columns=PLAN_COLUMNS)

    def finish() -> pd.DataFrame:
        upto(cell["hi"])
        inside = [f for f in found if f[5] <= cell["hi"]]
        ends = [f[5] - 1 for f in inside[1:]] + [cell["hi"]]
        return pd.DataFrame([[*f, end] for f, end in zip(inside, ends)], columns=PLAN_COLUMNS)

    step.finish = finish
    return step


PLAN_COLUMNS = [f.split()[0] for f in PLAN_SCHEMA.split(", ")]


def look_after(w: int, kept: int) -> int:
    """How far a cell looks after a round that kept so many rows up to an unplanned change: what is scored in vain follows
    what is kept, however long the windows are."""
    return min(w * LOOK_WINDOWS, max(kept * AFTER, AFTER_ROWS))


def _react(predictions, due, planned, cells) -> DataFrame:
    """Events, rate changes and the next state of each cell, up to the first row after which it is not as planned."""
    width = cells.select(*CELL, "w")
    bit = F.expr("shiftleft(1L, cast(idx % 32 as int))") * (F.col("pred") != F.col("label")).cast("long")
    # Packs end at check rows, so a check falls between two packs and never inside one.
    packs = (
        predictions.join(width, CELL)
        .groupBy(*CELL, F.floor(F.col("idx") / 32).alias("_p"), F.floor(F.col("idx") / F.col("w")).alias("_w"))
        .agg(F.min("idx").alias("first"), F.max("idx").alias("pos"), F.sum(bit).alias("bits"))
        .select(*CELL, "pos", F.lit(1).alias("turn"), "first", "bits")
    )
    # a planned segment comes just before its first row
    expected = planned.select(*CELL, (F.col("lo") - 1).alias("pos"), F.lit(3).alias("turn"), F.col("b").alias("train_from"), "lam")
    heads = _heads(cells).withColumn("pos", F.col("next_row") - 2)
    rows = (packs.unionByName(due.withColumn("turn", F.lit(2)), allowMissingColumns=True)
            .unionByName(heads, allowMissingColumns=True).unionByName(expected, allowMissingColumns=True))
    return ordered_fold(rows, CELL, ["pos", "turn"], _reaction_step, OUTCOME_SCHEMA)


def _reaction_step():
    cell: dict = {}

    def begin(row) -> None:
        cell.update(key=(row.stream, row.seed, row.model), next_row=int(row.next_row), hi=int(row.hi), look=int(row.look),
                    w=int(row.w), at=None, moved=None, plan=None, ahead=[], reactor=_cell_of(row))

    def as_planned() -> bool:
        """Whether the cell behind the row it last changed at is the planned one; else the round ends there."""
        reactor, at = cell["reactor"], cell["moved"]
        cell["moved"] = None
        if at is not None and (reactor.start, reactor.lam) != cell["plan"]:
            cell["at"] = at
        return cell["at"] is None

    def changed(at: int) -> None:
        if cell["reactor"].changed:
            cell["reactor"].changed, cell["moved"] = False, at

    def feed(row) -> None:
        reactor, pos = cell["reactor"], int(row.pos)
        if row.turn == 3:
            cell["ahead"].append((pos + 1, int(row.train_from), float(row.lam)))
        elif row.turn == 2:  # the check at the last row fed
            reactor.check(pos, row.signal, row.train_from)
            changed(pos)
        else:
            first = int(row.first)
            for idx, bit in enumerate(unpack(first, pos - first + 1, int(row.bits)), first):
                while cell["ahead"] and cell["ahead"][0][0] <= idx:
                    cell["plan"], cell["moved"] = cell["ahead"].pop(0)[1:], idx - 1
                if cell["moved"] is not None and not as_planned():
                    return
                reactor.error(idx, bit)
                changed(idx)

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        for row in batch.itertuples(index=False):
            if row.turn == 0:
                begin(row)
            elif cell["at"] is None:
                feed(row)
        return pd.DataFrame([], columns=OUTCOME_COLUMNS)

    def finish() -> pd.DataFrame:
        reactor, key = cell["reactor"], dict(zip(CELL, cell["key"]))
        stopped = cell["at"] is not None
        rows = [{**key, "what": "event", **event} for event in reactor.events]
        rows += [{**key, "what": "rate", "idx": idx, "lam": lam} for idx, lam in reactor.rates]
        next_row = (cell["at"] if stopped else cell["hi"]) + 1
        rows.append({
            **key, "what": "state", "next_row": next_row,
            "b": reactor.start, "lam": reactor.lam, "memory": json.dumps(reactor.memory()),
            "look": look_after(cell["w"], next_row - cell["next_row"]) if stopped else cell["look"] * FURTHER})
        # Plain objects with None: NaN would turn whole-number columns into floats.
        return pd.DataFrame(
            [[row.get(c) for c in OUTCOME_COLUMNS] for row in rows], columns=OUTCOME_COLUMNS, dtype=object)

    step.finish = finish
    return step
