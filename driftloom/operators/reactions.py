"""How a model answers its two signal channels; the one place for fusion, cooldowns, rates and rebuilds.

The parts are small and separate: `Channels` remembers what each channel raised last and until when it rests, `RateRule`
holds a strategy's rate in closed form over two counters, and `Cell` puts them together for one model. The batch plan and
the live learner feed cells with error bits and vocabulary checks in row order; `fusion` folds given signals through the
same parts. Positions are rows seen in the run, from 0 on, whatever the rows' own numbers are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from driftloom.operators.adwin import Adwin
from driftloom.operators.strategies import RATE_DIGITS
from driftloom.operators.vocabulary import CHANGE, NONE

VOCAB, ADWIN = "vocab", "adwin"
#: Channels that each fusion listens to. Fixed names.
HEARD = {"vocab_only": {VOCAB}, "adwin_only": {ADWIN}, "or": {VOCAB, ADWIN}, "and": {VOCAB, ADWIN}}
OTHER = {VOCAB: ADWIN, ADWIN: VOCAB}


@dataclass
class Channels:
    """As-of memory of both channels: `raised` at which position last, and the position from which each is `free` again."""

    fusion: str
    confirm_window: int
    cooldown: int
    raised: dict = field(default_factory=dict)
    free: dict = field(default_factory=dict)

    def gate(self, channel: str, at: int, kind: str) -> str:
        """The signal after fusion. Under `and` it takes a raised signal of the other channel, no further back than the
        confirm window, and is a change then whatever it was."""
        if kind == NONE or self.fusion != "and":
            return kind
        other = self.raised.get(OTHER[channel])
        return CHANGE if other is not None and at - other <= self.confirm_window else NONE

    def note(self, channel: str, at: int, kind: str) -> None:
        if kind != NONE:
            self.raised[channel] = at

    def rested(self, channel: str, at: int) -> bool:
        return at >= self.free.get(channel, at)

    def rest(self, channel: str, at: int) -> None:
        self.free[channel] = at + self.cooldown


@dataclass
class RateRule:
    """Rate of a strategy from the `steps` it has taken and the `calm` checks since the last change."""

    strategy: str
    low: float
    top: float
    step: float
    decrease: float
    steps: int = 0
    calm: int = 0

    @classmethod
    def of(cls, spec: dict, counters=(0, 0)) -> "RateRule":
        return cls(spec["strategy"], spec["lam"], spec["lam_max"], spec["c"], spec["decrease"], *counters)

    def rate(self) -> float:
        if not self.steps or self.strategy == "Rebuild":
            return self.low
        raised = min(self.low + self.step * self.steps, self.top)
        faded = self.top * (1 - self.decrease) ** self.calm
        value = {
            "SlowIncreaseUpToALimit": raised,
            "SlowIncreaseFastReset": raised,
            "FastSetFastReset": self.low if self.calm else self.top,
            "FastSetSlowDecrease": faded if not self.calm or faded > self.low + 1e-9 else self.low,
        }[self.strategy]
        return round(value, RATE_DIGITS)

    def hear(self, kind: str) -> bool:
        """Take in a check; whether the rate is another one now."""
        before = self.rate()
        if self.strategy == "SlowIncreaseFastReset" and before >= self.top:
            self.steps = self.calm = 0  # the reset swallows the signal
        elif kind == CHANGE:
            self.steps, self.calm = self.steps + 1, 0
        else:
            self.calm += 1
        return self.rate() != before


class Cell:
    """One adaptive model: `start` is the first position it has learned from, `lam` its rate."""

    def __init__(self, spec: dict, start: int = 0, lam: float | None = None, memory: dict | None = None):
        memory = memory or {}
        self.spec, self.start, self.lam = spec, start, spec["lam"] if lam is None else lam
        self.window = Adwin(spec["adwin_delta"])
        if memory:
            self.window.load(memory["window"])
        self.channels = Channels(spec["fusion"], spec["confirm_window"], spec["cooldown"], memory.get("raised", {}), memory.get("free", {}))
        self.rule = RateRule.of(spec, memory.get("counters", (0, 0)))
        self.fast = memory.get("fast")
        self.events: list[dict] = []
        self.rates: list[tuple[int, float]] = []
        self.changed = False

    def memory(self) -> dict:
        return {"window": self.window.dump(), "raised": self.channels.raised, "free": self.channels.free,
                "counters": [self.rule.steps, self.rule.calm], "fast": self.fast}

    def hears(self, channel: str) -> bool:
        return channel in HEARD[self.spec["fusion"]]

    def error(self, at: int, bit: int) -> None:
        """The error bit of the row at a position; comes before the check that ends there."""
        if self.fast is not None and at >= self.fast:
            self.end_fast(at)
        if self.hears(ADWIN) and at >= self.spec["warmup_rows"] and self.window.update(bit):
            if self._decide(ADWIN, at, CHANGE, width=self.window.width, error_rate=round(self.window.mean, 4)) == CHANGE:
                self.channels.rest(ADWIN, at)
                if self.spec["adwin_reaction"] == "rebuild":
                    self._restart(ADWIN, at, rebuild_start(at, self.window.width, self.spec["min_rebuild"], self.spec["buffer_rows"]))
                else:
                    self.fast = at + self.spec["w"]
                    self._show(at)

    def end_fast(self, at: int) -> None:
        self.fast = None
        self._show(at)

    def check(self, at: int, kind: str, train_from) -> None:
        """A vocabulary check, at the last row of its window."""
        if not self.hears(VOCAB):
            return
        decided = self._decide(VOCAB, at, kind)
        if self.spec["strategy"] == "Rebuild":
            reacts = decided == CHANGE
            if reacts:
                self._restart(VOCAB, at, int(train_from))
        else:
            moved = self.rule.hear(decided)
            reacts = moved and decided == CHANGE
            if moved:
                self._show(at)
        if reacts:
            self.channels.rest(VOCAB, at)

    def _decide(self, channel: str, at: int, kind: str, **more) -> str:
        """What is left of a signal after fusion and cooldown; a raised one is logged."""
        gated = self.channels.gate(channel, at, kind)
        decided = NONE if gated == CHANGE and not self.channels.rested(channel, at) else gated
        if kind != NONE:
            self.events.append(event(at, channel, kind, acted=decided == CHANGE, **more))
        self.channels.note(channel, at, kind)
        return decided

    def _restart(self, channel: str, at: int, start: int) -> None:
        self.start, self.changed = start, True
        self.events.append(event(at, channel, "rebuild", rebuild_size=at - start + 1))

    def _show(self, at: int) -> None:
        """Put the rate in force: the fast one while a fast period lasts, the strategy's own otherwise."""
        lam = self.rule.rate() if self.fast is None else self.spec["lam_max"]
        if lam != self.lam:
            self.lam, self.changed = lam, True
            self.rates.append((at, lam))


def event(at: int, detector: str, kind: str, **more) -> dict:
    return {"idx": at, "detector": detector, "kind": kind, "acted": None, "rebuild_size": None, "width": None, "error_rate": None} | more


def rebuild_start(at: int, width: int, least: int, most: int) -> int:
    """First position of the rows that the error channel rebuilds from."""
    return max(at + 1 - min(max(width, least), most), 0)
