"""Token ids of whole texts by a public tokenizer file.

The tokenizer never merges over blanks, so a text's ids are those of its blank-separated pieces one after the other.
Each distinct piece of a batch is encoded once; a worker keeps the ids of the pieces it has met, up to `KEPT` of them.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex

from driftloom.llm import text as tx

#: Pieces that one Python worker remembers at most; beyond that it starts again with those of the batch at hand.
KEPT = 1_500_000
BATCH = 12 << 20
#: Pieces of these characters lower-case and split alike in every Unicode version, so the file's own rules are applied
#: to them in bulk; all other pieces go through the tokenizer as they are.
ODD = r"[^\x21-\x7e\xa1-\u024f\n]"


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes Arrow text columns; `keys` are hashes of known pieces, sorted, `start` and `count` their place in `ids`."""

    held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            rules = json.load(file)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        lowers = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.odd = re.compile("|".join([ODD, *(re.escape(x["content"]) for x in rules["added_tokens"])]))
        self.pattern = None
        if lowers and [x["type"] for x in steps] == ["Split", "ByteLevel"] and rules["model"].get("end_of_word_suffix"):
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")
            # the same model over words that are normal and apart already
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.closes = np.zeros(self.words.get_vocab_size(), dtype=bool)
            self.closes[[i for t, i in self.words.get_vocab().items() if t.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder for each worker process and file."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.start = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int32)
        self.ids = np.empty(0, dtype=np.int32)
        self.met = Numbered()
        self.word_ids = np.empty(0, dtype=np.int32)
        self.word_ends = np.zeros(1, dtype=np.int64)

    def encode_pieces(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (one in each line) one after the other, and how many each has."""
        if self.pattern is None:
            return self.encode_any(lines.split("\n"))
        if self.odd.search(lines) is None:
            return self.encode_plain(lines)
        pieces = lines.split("\n")
        plain = np.array([self.odd.search(p) is None for p in pieces], dtype=bool)
        ids, count = self.encode_plain("\n".join(p for p, x in zip(pieces, plain) if x))
        more, counts = self.encode_any([p for p, x in zip(pieces, plain) if not x])
        total, start = np.empty(len(pieces), dtype=np.int32), np.empty(len(pieces), dtype=np.int64)
        total[plain], total[~plain] = count, counts
        start[plain], start[~plain] = np.cumsum(count) - count, len(ids) + np.cumsum(counts) - counts
        return np.concatenate([ids, more])[tx.ragged(start, total.astype(np.int64))], total

    def encode_plain(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        if not lines:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        found = self.pattern.findall(lines.lower())
        met = self.met
        known = len(met)
        at = np.array(list(map(met.__getitem__, found)), dtype=np.int64)
        if len(met) > known:
            new = list(itertools.islice(met, known, None))
            ids, ends, total = [], [], 0
            for i in range(0, len(new), 2048):
                some = [w if w != "\n" else "." for w in new[i:i + 2048]]
                e = np.array(self.words.encode(" ".join(some), add_special_tokens=False).ids, dtype=np.int32)
                last = np.flatnonzero(self.closes[e]) + 1
                assert len(last) == len(some)
                ends.append(last + total)
                ids.append(e)
                total += len(e)
            self.word_ends = np.concatenate([self.word_ends, len(self.word_ids) + np.concatenate(ends)])
            self.word_ids = np.concatenate([self.word_ids, *ids])
        start, end = self.word_ends[at], self.word_ends[at + 1]
        line = met.get("\n", -1)
        count = np.where(at == line, 0, end - start)
        breaks = np.flatnonzero(at == line)
        bounds = np.concatenate([[0], np.cumsum(count)])
        edges = bounds[np.concatenate([[0], breaks, [len(at)]])]
        return self.word_ids[tx.ragged(start, count)], np.diff(edges).astype(np.int32)

    def encode_any(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, dtype=np.int32) for i in range(0, len(pieces), 4096)
                for e in self.tokenizer.encode_batch_fast(pieces[i:i + 4096], add_special_tokens=False)]
        return np.concatenate([np.empty(0, dtype=np.int32), *each]), np.array([len(e) for e in each], dtype=np.int32)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with `end` after each (int32), and where each text's ids begin (one more at the end)."""
        words = tx.split(texts, tx.BLANKS, lower=False)
        h = tx.hashes(words)
        known, at, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, known)
        place[place == len(self.keys)] = 0
        new = self.keys[place] != known if len(self.keys) else np.ones(len(known), dtype=bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KEPT:
                self.forget()
                new = np.ones(len(known), dtype=bool)
            s, e = words.starts[at[new]], words.ends[at[new]]
            room = e - s + 1
            lines = np.full(int(room.sum()) - 1, 0x0A, dtype=np.uint8)
            lines[tx.ragged(np.cumsum(room) - room, e - s)] = words.data[tx.ragged(s, e - s)]
            ids, count = self.encode_pieces(lines.tobytes().decode())
            keys = np.concatenate([self.keys, known[new]])
            start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            order = np.argsort(keys, kind="stable")
            self.count = np.concatenate([self.count, count])[order]
            self.keys, self.start, self.ids = keys[order], start[order], np.concatenate([self.ids, ids])
            place = np.searchsorted(self.keys, known)
        # `end` stands in as one more piece after each document's words
        docs = len(words.first) - 1
        source = np.concatenate([self.ids, np.array([end], dtype=np.int32)])
        start, count = self.start[place][back], self.count[place][back].astype(np.int64)
        spot = words.first[1:]
        start = np.insert(start, spot, len(self.ids))
        count = np.insert(count, spot, 1)
        out = source[tx.ragged(start, count)]
        ends = np.cumsum(count)
        first = np.zeros(docs + 1, dtype=np.int64)
        first[1:] = ends[words.first[1:] + np.arange(docs)]
        return out, first
