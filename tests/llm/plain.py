"""Plain Python versions of the operators' rules, for small inputs."""

from __future__ import annotations

import re

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})
BLANKS = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=BLANKS, lower=True):
    text = text or ""
    return re.findall(pattern, text.translate(LOW) if lower else text)


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def similar_groups(texts: dict, size: int, percent: int):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    groups = Groups(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                groups.link(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def removed_words(rows, window=50):
    """rows of (doc_id, text), ids distinct: {doc_id: (n_words, removed, kept text)}"""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text, lower=False)
        own, hit = [], set()
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            own.append(key)
            if key in seen:
                hit.update(range(j, j + window))
        seen.update(own)
        out[i] = (len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit))
    return out


def contaminated(text, items, window=13):
    """(words, hit words, sorted items) of a text against (item_id, text) rows."""
    w, hit, found = words(text, LETTERS), set(), set()
    for item, other in items:
        v = words(other, LETTERS)
        n = min(window, len(v))
        parts = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j:j + n]) in parts:
                hit.update(range(j, j + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeated_lines(rows, percent=80):
    """{doc_id: line numbers that go}, for rows of (doc_id, text) with distinct ids."""
    before, out = [], {}
    for i, text in sorted(rows):
        out[i] = []
        for j, line in enumerate((text or "").split("\n") if text is not None else []):
            s = {x for x in line.lower().split(" ") if x}
            if s:
                if any(100 * len(s & o) >= percent * len(s | o) for o in before):
                    out[i].append(j)
                before.append(s)
    return out
