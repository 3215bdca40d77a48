"""Personal data in texts: emails, IP addresses, card numbers and phone numbers.

Base spans come from fixed patterns and checks; they always stay. Beyond them, generators of high recall propose further,
overlapping spans (obfuscated addresses, numbers in other groupings, runs of groups within longer ones, IPv6). Boosted
trees, one model for each kind, score a proposal by its format and its context; scores are calibrated on examples that the
trees did not see, and the threshold of a kind is the least calibrated score with a precision of PRECISION there. What
passes and does not overlap a base span is taken in order of score, without overlaps.

No labels exist, so the trees learn from planted examples: EXAMPLES of each kind and as many lookalikes (dates, amounts,
versions, order numbers, numbers that fail a check) are written into contexts from a sample of SAMPLE texts, the first
CONTEXT characters of the distinct texts with the least hashes; this bounded sample only fits the model. A proposal is a
positive example if it is the planted span itself. A sample without text leaves the base spans alone.

Null text is empty and has no spans. Texts are processed whole, in time linear in their length: proposals are bounded (a
local part of 64 characters, 5 labels, 8 groups of digits), as such data are. Offsets are code points, the end exclusive.
Repeated ids and rows give a row each; a null id stays null. Other columns are not read (`find`) or kept (`redacted`).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import text as tx
from driftloom.llm.base import query, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE, CONTEXT, EXAMPLES, PRECISION = 1500, 4000, 2000, 0.99
ROUNDS, DEPTH, BINS, RATE = 60, 4, 32, 0.3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SMALL = re.compile(r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind, in order of start, then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            out.append(("email", begin, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in QUAD.finditer(text) if all(SMALL.fullmatch(p) for p in m[0].split("."))]
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 40:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in DIALLED.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- proposals -------------------------------------------------------------------------------------------------------

GAP = "[ \\t\u00a0]"
AT = re.compile(rf"[@\uff20]|[(\[{{<]{GAP}?(?:at|AT|@){GAP}?[)\]}}>]|(?<={GAP})(?:at|AT)(?={GAP})")
DOT = re.compile(rf"{GAP}?(?:\.|[(\[{{<]{GAP}?(?:dot|DOT|\.){GAP}?[)\]}}>]|(?<={GAP})(?:dot|DOT)(?={GAP})){GAP}?")
LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
LABELS, GROUPS = 5, 8
BETWEEN = r"[ \t\u00a0().\-/_\u2013\[\]]{1,3}"
CHAIN = re.compile(rf"[0-9]++(?:{BETWEEN}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")


def proposals(text: str) -> Iterator[tuple[str, int, int, tuple]]:
    """(kind, start, end, parts): parts are the forms of an address or the groups of a number."""
    for at in AT.finditer(text):
        end = at.start()
        gap = end > 0 and text[end - 1] in " \t\u00a0"
        end -= gap
        begin = end
        while begin > max(0, end - 64) and text[begin - 1] in LOCAL:
            begin -= 1
        while begin < end and text[begin] in ".-%+_":
            begin += 1
        if begin == end:
            continue
        place = at.end()
        space = place < len(text) and text[place] in " \t\u00a0"
        label = LABEL.match(text, place + space)
        labels, dots = [], []
        while label and len(labels) < LABELS:
            labels.append(label[0])
            if len(labels) > 1:
                yield "email", begin, label.end(), (text[begin:end], at[0], gap + space, tuple(labels), tuple(dots))
            dot = DOT.match(text, label.end())
            if not dot:
                break
            dots.append(dot[0])
            label = LABEL.match(text, dot.end())
    for m in COLONS.finditer(text):
        if m[0].count("::") <= 1 and (m[0].count(":") == 7 or "::" in m[0]) and any(c in "0123456789abcdefABCDEF" for c in m[0]):
            yield "ip", m.start(), m.end(), (m[0],)
    for chain in CHAIN.finditer(text):
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, chain.start(), chain.end())]
        for i, (begin, _) in enumerate(groups):
            total = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                run = tuple(text[s:e] for s, e in groups[i:j + 1])
                gaps = tuple(text[groups[k][1]:groups[k + 1][0]] for k in range(i, j))
                end = groups[j][1]
                if 12 <= total:
                    yield "card", begin, end, (run, gaps)
                if 7 <= total <= 15:
                    first = begin
                    if first and text[first - 1] == "(":
                        first -= 1
                    if first and text[first - 1] == "+":
                        first -= 1
                    yield "phone", first, end, (run, gaps)
                if j == i + 3 and all(len(g) <= 3 for g in run):
                    yield "ip", begin, end, (run, gaps)


# ---- features --------------------------------------------------------------------------------------------------------

#: Ends of domains, and words that tend to stand before each kind or before lookalikes.
ENDS = frozenset("com org net edu gov info io de fr es it uk eu us co ch at nl be pl ru jp br".split())
CUES = {
    "email": frozenset("mail email e-mail contact write address mailto adresse courriel correo kontakt".split()),
    "ip": frozenset("ip host server address node login addr".split()),
    "card": frozenset("card visa mastercard amex credit payment pay karte carte tarjeta".split()),
    "phone": frozenset("tel phone call mobile fax cell telefon telefono contact ring whatsapp".split()),
}
LOOKALIKE = frozenset("version v release order invoice id ref no nr isbn total price section chapter date item page year build sku".split())
WORD = re.compile(r"[\w.-]+")
GAPS = (" ", "-", ".", "/", "(", "\u00a0", "\u2013", "_")


def around(kind: str, text: str, start: int, end: int) -> list[float]:
    before, after = text[start - 1:start], text[end:end + 1]
    left = text[max(0, start - 40):start]
    words = [w.lower().strip(".-") for w in WORD.findall(left)[-3:]]
    return [
        before.isalpha(), before.isdigit(), before in tuple("#$\u20ac\u00a3") and bool(before), before in tuple(".,-/:_=") and bool(before), not before or before.isspace(),
        after.isalpha(), after.isdigit(), after in tuple("%\u20ac$\u00b0") and bool(after), after in tuple("-/:_@=") and bool(after),
        text[end:end + 2][:1] in (".", ",") and text[end + 1:end + 2].isalnum(),
        any(w in CUES[kind] for w in words), any(w in LOOKALIKE for w in words),
        text[start - 2:start][:1].isdigit() and start > 1, text[end + 1:end + 2].isdigit(),
    ]


def address_features(parts: tuple) -> list[float]:
    local, at, gaps, labels, dots = parts
    last = labels[-1]
    bare = at.lower() == "at"
    return [
        len(local), sum(c.isdigit() for c in local), "." in local or "_" in local, local[-1:] in "._%+-", at in "@\uff20", at == "\uff20", bare, gaps,
        len(labels), len(last), last.lower() in ENDS, last.isalpha(), last[:1].isupper(), any(c.isdigit() for c in last),
        sum(d == "." for d in dots), sum("[" in d or "(" in d or "{" in d or "<" in d for d in dots), sum("dot" in d.lower() for d in dots),
        sum(d[-1:].isspace() and "." in d for d in dots), max(len(x) for x in labels[:-1]), any(x[:1] == "-" or x[-1:] == "-" for x in labels),
    ]


def number_features(parts: tuple, lead: str) -> list[float]:
    run, gaps = parts
    digits = "".join(run)
    sizes = [len(g) for g in run]
    values = [int(g) for g in run]
    return [
        len(digits), len(run), min(sizes), max(sizes), sizes[0], sizes[-1], sizes[1] if len(sizes) > 1 else 0, len(set(gaps)), max(map(len, gaps), default=0),
        *[any(g in x for x in gaps) for g in GAPS], luhn(digits), int(digits[0]), len(set(digits)), max(values), sum(g[0] == "0" and len(g) > 1 for g in run),
        sizes == [4] * len(sizes), sizes[-2:] == [3, 4], sizes == [4, 6, 5], "+" in lead, "(" in lead, digits[:2] == "00", digits[:2] in ("19", "20"),
        len(run) > 2 and sizes[0] in (2, 4) and values[1] <= 12 and values[2] <= 31, any("[" in x for x in gaps), all(x in (".", "[.]", "(.)") for x in gaps),
    ]


def features(kind: str, text: str, start: int, end: int, parts: tuple) -> list[float]:
    """The format of a proposal, then its context; as many numbers for every proposal of a kind."""
    if kind == "email":
        form = address_features(parts)
    elif len(parts) == 1:
        form = [100.0 + parts[0].count(":"), "::" in parts[0], len(parts[0])] + [0.0] * (NUMBERS - 3)
    else:
        form = number_features(parts, text[start:start + 2])
    return [float(x) for x in form + around(kind, text, start, end)]


NUMBERS = len(number_features((("1",), ()), ""))


# ---- boosted trees ---------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Trees of one kind as arrays (feature, cut, left, right, value), the calibration of their sum, and the threshold."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                lower = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(lower, left[node], right[node]), node)
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def boosted(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Trees that fit the gradient of the logistic loss, with cuts at quantiles and second-order leaf values."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        rows_of, tree = [np.arange(len(y))], [[-1, 0.0, 0, 0, 0.0]]
        leaves = [0]
        for depth in range(DEPTH):
            grown = []
            for node in leaves:
                rows = rows_of[node]
                best = (1e-6, -1, 0)
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    of_g = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=len(cuts[f]) + 1))[:-1]
                    of_h = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=len(cuts[f]) + 1))[:-1]
                    gain = of_g**2 / (of_h + 1) + (sum_g - of_g) ** 2 / (sum_h - of_h + 1) - sum_g**2 / (sum_h + 1)
                    gain[(of_h < 1e-3) | (sum_h - of_h < 1e-3)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                tree[node][4] = -RATE * sum_g / (sum_h + 1)
                if best[1] < 0:
                    continue
                lower = binned[rows, best[1]] <= best[2]
                tree[node][:4] = [best[1], cuts[best[1]][best[2]], len(tree), len(tree) + 1]
                for part in (rows[lower], rows[~lower]):
                    rows_of.append(part)
                    grown.append(len(tree))
                    tree.append([-1, 0.0, 0, 0, -RATE * g[part].sum() / (h[part].sum() + 1)])
            leaves = grown
        columns = tuple(np.array(c, dtype=t) for c, t in zip(zip(*tree), (np.int64, float, np.int64, np.int64, float)))
        trees.append(columns)
        margin += Model([columns]).margin(x)
    return trees


def calibrated(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope and shift by damped Newton steps on the logistic loss, with targets drawn in a little; then the threshold."""
    m = model.margin(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    z = np.stack([m, np.ones_like(m)], axis=1)

    def loss(w):
        return (np.logaddexp(0, z @ w) - target * (z @ w)).sum()

    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - target))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])
    p = model.score(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= PRECISION) & np.append(p[order][1:] < p[order][:-1], True))
    model.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0
    return model


# ---- planted examples ------------------------------------------------------------------------------------------------

def digits_of(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def card_number(r, n: int = 16, valid: bool = True) -> str:
    d = str(r.integers(3, 7)) + digits_of(r, n - 2)
    return next(d + str(c) for c in r.permutation(10) if luhn(d + str(c)) == valid)


def grouped(d: str, sizes: list[int], gap: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(d[at:at + n])
        at += n
    return gap.join(out)


def pick(r, options):
    return options[int(r.integers(len(options)))]


def planted(r, kind: str, word) -> tuple[str, str, str]:
    """Text before, the span itself, text after: an example of the kind, word() gives words of the corpus."""
    if kind == "email":
        local = pick(r, [word(), f"{word()}.{word()}", f"{word()}{r.integers(100)}", f"{word()}_{word()}", f"{word()[0]}.{word()}", f"{word()}.{r.integers(100):02d}"])
        labels = [word() + (str(r.integers(10)) if r.random() < 0.3 else "")] + ([pick(r, ["example", "mail", word()])] if r.random() < 0.4 else []) + [pick(r, sorted(ENDS))]
        at, dot = pick(r, [("@", "."), (" @ ", "."), (" at ", " dot "), (" at ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "),
                           ("{at}", "."), ("\uff20", "."), ("@", "[.]"), (" AT ", " DOT "), ("[at]", "."), (" [at] ", "."), (" (at) ", ".")])
        return pick(r, ["", "", "", "mail ", "contact: "]), local + at + dot.join(labels), pick(r, ["", "", ".", ","])
    if kind == "ip":
        quad = [str(r.integers(0, 256)) for _ in range(4)]
        six = ":".join(f"{r.integers(0, 65536):x}" for _ in range(8))
        span = pick(r, [".".join(quad), "[.]".join(quad), "(.)".join(quad), six, f"fe80::{r.integers(0, 65536):x}:{r.integers(0, 65536):x}", f"2001:db8::{r.integers(0, 65536):x}"])
        return pick(r, ["", "", "ip ", "host "]), span, pick(r, ["", "", ".", ":80" if "." in span else ""])
    if kind == "card":
        gap = pick(r, ["", " ", "-", ".", "\u00a0", "\u2013", "/", "_", "  "])
        sizes = pick(r, [[4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [8, 8], [16], [13]])
        span = grouped(card_number(r, sum(sizes)), sizes, gap)
        before = card_number(r) + " " if r.random() < 0.15 else pick(r, ["", "", "card ", "visa: "])
        return before, span, pick(r, ["", "", ".", " " + card_number(r)])
    area, mid, end = digits_of(r, 3), digits_of(r, 3), digits_of(r, 4)
    span = pick(r, [f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+{r.integers(1, 99)} {area} {mid}{end}", f"+1 ({area}) {mid}-{end}", f"00{r.integers(30, 60)} {area} {mid} {end}",
                    f"0{area[:2]}/{mid}{end}", f"0{area} {mid}{end}", f"1-{area}-{mid}-{end}", f"+{r.integers(30, 60)}\u00a0{area}\u00a0{mid}\u00a0{end}", f"+{r.integers(30, 60)}/{area}/{mid}{end}", f"({area}) {mid} {end}",
                    f"+{r.integers(30, 60)} (0){area[:2]} {mid} {end}", f"00{r.integers(30, 60)} {area[:2]} {mid}{end[:3]} {end[2:]}"])
    return pick(r, ["", "", "tel ", "call ", "phone: "]), span, pick(r, ["", "", ".", ","])


def lookalike(r, word) -> tuple[str, str]:
    """A text with numbers or words that are no personal data, and what stands before it."""
    y, m, d = r.integers(1950, 2030), r.integers(1, 13), r.integers(1, 29)
    many = [
        lambda: f"{y}-{m:02d}-{d:02d} {r.integers(24):02d}:{r.integers(60):02d}", lambda: f"{d:02d}.{m:02d}.{y}", lambda: f"{d}/{m}/{y} {r.integers(1000)}", lambda: f"{y}-{y + 3} {digits_of(r, 4)}",
        lambda: f"{r.integers(1, 9)}.{r.integers(20)}.{r.integers(20)}", lambda: f"{r.integers(300, 999)}.{r.integers(256)}.{r.integers(256)}.{r.integers(256)}", lambda: f"{r.integers(20)}, {r.integers(20)}, {r.integers(20)}, {r.integers(20)}",
        lambda: card_number(r, int(r.integers(12, 20)), False), lambda: grouped(card_number(r, 16, False), [4, 4, 4, 4], pick(r, [" ", "-", "."])), lambda: digits_of(r, int(r.integers(7, 12))), lambda: digits_of(r, int(r.integers(20, 30))),
        lambda: f"{r.integers(1, 999)} {digits_of(r, 3)} {digits_of(r, 3)}", lambda: f"{digits_of(r, 6)}.{digits_of(r, 4)}", lambda: f"{r.random() * 90:.6f} {r.random() * 90:.6f}", lambda: f"{r.integers(10):d}{digits_of(r, 6)}.{digits_of(r, 2)}",
        lambda: f"978-{digits_of(r, 1)}-{digits_of(r, 2)}-{digits_of(r, 6)}-{digits_of(r, 1)}", lambda: "".join(pick(r, list("0123456789abcdef")) for _ in range(40)), lambda: f"{word()} at {word()}. {word().capitalize()}", lambda: f"{word()} at {word()} {word()}.{word()}",
        lambda: f"{word()}@{word()}", lambda: f"{r.integers(24):02d}:{r.integers(60):02d}:{r.integers(60):02d}", lambda: f"{word()} at {r.integers(12)}.{r.integers(10, 60)}", lambda: f"{digits_of(r, 3)}-{digits_of(r, 2)}-{digits_of(r, 4)}",
    ]
    return pick(r, ["", "", "", "version ", "order ", "#", "$", "id ", "isbn ", "total "]), pick(r, many)()


def examples(texts: list[str], count: int, seed: int = 11) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each kind features and labels of the proposals around planted spans and lookalikes."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()]
    rows: dict[str, list] = {k: [] for k in KINDS}
    labels: dict[str, list] = {k: [] for k in KINDS}
    if not texts:
        return {}
    words = sorted({w for t in texts for w in re.findall(r"[a-z]{3,12}", t)}) or ["word"]
    word = lambda: pick(r, words)
    for n in range(count * (len(KINDS) + 1)):
        text = pick(r, texts)
        at = int(r.integers(0, len(text) + 1))
        while 0 < at < len(text) and not text[at].isspace():
            at += 1
        left, right = text[max(0, at - 80):at], text[at:at + 80]
        kind = KINDS[n % 5] if n % 5 < len(KINDS) else None
        if r.random() < 0.3:  # other numbers and addresses close by
            left += " " + "".join(planted(r, pick(r, KINDS), word)) + " " + word()
        if r.random() < 0.3:
            right = " " + word() + " " + "".join(planted(r, pick(r, KINDS), word)) + " " + right
        before, span, after = planted(r, kind, word) if kind else (*lookalike(r, word), pick(r, ["", "", ".", ",", "%"]))
        head = left + ("" if not left or left[-1].isspace() else " ") + before
        whole = head + span + after + ("" if not right or right[0].isspace() else " ") + right
        begin, end = len(head), len(head) + len(span)
        for k, s, e, parts in proposals(whole):
            if s < end + len(after) and e > begin - len(before):
                rows[k].append(features(k, whole, s, e, parts))
                labels[k].append(float(k == kind and (s, e) == (begin, end)))
    return {k: (np.array(rows[k]), np.array(labels[k])) for k in KINDS if 0 < sum(labels[k]) < len(labels[k])}


def fitted(texts: list[str], count: int = EXAMPLES) -> dict[str, Model]:
    """A model for each kind; every fourth example calibrates, the others grow the trees."""
    out = {}
    for kind, (x, y) in examples(texts, count).items():
        held = np.arange(len(y)) % 4 == 3
        out[kind] = calibrated(Model(boosted(x[~held], y[~held])), x[held], y[held])
    return out


def fit(docs: DataFrame) -> dict[str, Model]:
    """Models from the sample of `docs` (doc_id, text)."""
    # rows below a hash that lets twice the sample through, one for each hash: what meets at the driver is the sample only
    share = min(1.0, 2 * SAMPLE / max(1, docs.count()))
    text = F.substring(F.col("text").cast("string"), 1, CONTEXT)
    some = docs.where("text is not null").select(F.xxhash64("text").alias("order"), text.alias("start"))
    some = some.where(F.shiftrightunsigned("order", 11) <= int(share * (1 << 53))).groupBy("order").agg(F.min("start").alias("start"))
    some = some.orderBy("order").limit(SAMPLE)
    return fitted([r["start"] for r in some.collect()])


# ---- spans of documents ----------------------------------------------------------------------------------------------

def all_spans(texts: list[str], models: dict[str, Model]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    based = [base_spans(t) for t in texts]
    found: dict[str, list] = {k: [] for k in models}
    rows: dict[str, list] = {k: [] for k in models}
    for i, text in enumerate(texts):
        taken = np.array([s[1:] for s in based[i]], dtype=np.int64).reshape(-1, 2)
        for kind, start, end, parts in proposals(text):
            if kind in models and not ((taken[:, 0] < end) & (taken[:, 1] > start)).any():
                found[kind].append((i, start, end))
                rows[kind].append(features(kind, text, start, end, parts))
    passed: dict[int, list] = {}
    for kind, model in models.items():
        if rows[kind]:
            p = model.score(np.array(rows[kind]))
            for k in np.flatnonzero(p >= model.threshold):
                i, start, end = found[kind][k]
                passed.setdefault(i, []).append((-round(float(p[k]), 9), -(end - start), start, KINDS.index(kind), end))
    out = []
    for i, base in enumerate(based):
        added, room = [], []
        for _, _, start, kind, end in sorted(passed.get(i, [])):
            k = bisect.bisect(room, (start, end))
            if not (k and room[k - 1][1] > start) and not (k < len(room) and room[k][0] < end):
                room.insert(k, (start, end))
                added.append((KINDS[kind], start, end))
        out.append((base, sorted(added, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, base and added (lists of kind, start, end) for every row of `docs`."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in tx.parts(batches):
            both = all_spans([t or "" for t in batch.column("text").to_pylist()], held.value)
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b[k]] for b in both], pa.list_(span)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def redacted(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets; of overlapping spans the first stands for all."""
    held, schema = docs.sparkSession.sparkContext.broadcast(models), docs.schema

    def run(batches):
        for batch in tx.parts(batches):
            texts = batch.column("text").to_pylist()
            out = []
            for text, (base, added) in zip(texts, all_spans([t or "" for t in texts], held.value)):
                parts, end = [], 0
                for kind, s, e in sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))):
                    if s >= end:
                        parts += [text[end:s], f"[{kind}]"]
                    end = max(end, e)
                out.append(None if text is None else "".join(parts) + text[end:])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(
        F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(both).alias("spans"), F.size("added").cast("long").alias("n_added"))
