"""Personal data, hard negatives and phrases against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftloom.llm import negatives, personal, phrases
from pyspark.sql import functions as F

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


# ---- personal data ---------------------------------------------------------------------------------------------------

def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or plain_luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
              "+1 (361) 555-8283", "+1", "+12 ", "+(1) 2", "é", " ", "\n", "-", ".", "5", "12", "word", "+49.30.1234-567", "4111  1111", "a@b.c.", "%+-@a-.b", "😀"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1 " * 100_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "a at " * 40_000, "f:" * 100_000):
        base, added = personal.all_spans([text], {})[0]
        assert isinstance(base, list) and added == []
        assert sum(1 for _ in personal.proposals(text)) < 20 * len(text)


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return personal.fit(docs)


def test_held_out_proposals(spark, models):
    """Examples in texts that the models did not see: few lookalikes pass, most planted spans do."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()[4000:5000]
    for kind, (x, y) in personal.examples([t[:4000] for t in texts], 300, seed=77).items():
        hit = models[kind].score(x) >= models[kind].threshold
        assert (hit & (y > 0)).sum() >= 0.85 * y.sum(), kind
        assert (hit & (y > 0)).sum() >= 0.97 * hit.sum(), kind
    # ordinary prose has next to nothing beyond the base spans
    added = sum(len(a) for _, a in personal.all_spans(texts, models))
    assert added <= 2


def test_spans_of_rows(spark, models):
    rows = [(1, "write to jane.doe (at) example (dot) org today"), (2, None), (3, ""), (None, "mail a@b.co"), (3, "tel (361) 555-8283 or write to 1.2.3.4"), (3, "tel (361) 555-8283 or write to 1.2.3.4"),
            (4, "x " * 60_000 + "a@b.co")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, added int")
    got = Counter((r["doc_id"], tuple(map(tuple, r["base"])), tuple(map(tuple, r["added"]))) for r in personal.find(docs, models).collect())
    address = rows[0][1]
    span = ("email", address.index("jane"), address.index(" today"))
    number = rows[4][1]
    both = ((("ip", 31, 38),), (("phone", 4, 18),))
    assert number[4:18] == "(361) 555-8283"
    assert got == Counter([(1, (), (span,)), (2, (), ()), (3, (), ()), (None, (("email", 5, 11),), ()), (3, *both), (3, *both), (4, (("email", 120_000, 120_006),), ())])
    texts = {r["text"] for r in personal.redacted(docs, models).where("doc_id = 3").collect()}
    assert texts == {"", "tel [phone] or write to [ip]"}
    assert personal.redacted(docs, models).columns == docs.columns
    assert personal.find(docs.limit(0), models).count() == 0
    assert personal.fit(docs.limit(0)) == {} and personal.fit(docs.where("text is null or text = ''")) == {}
    alone = personal.find(docs, {}).where("doc_id = 1").first()
    assert alone["base"] == [] and alone["added"] == []


def test_query_columns(spark):
    from driftloom import llm

    got = llm.QUERIES["op11_personal_data"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


# ---- hard negatives --------------------------------------------------------------------------------------------------

def plain_negatives(rows):
    """rows of (id, label, vector) that take part, distinct: results as a counter."""
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = Counter()
    for a, (i, lab, v) in enumerate(rows):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(rows) if b != a and len(v) == len(w)]
        for ps, p, _ in sorted((s for s in scored if s[2] == lab), key=lambda s: s[:2])[:5]:
            near = sorted((s for s in scored if s[2] != lab and 50 * -ps <= 100 * -s[0] <= 95 * -ps), key=lambda s: s[:2])[:3]
            for rank, (ns, n, _) in enumerate(near, 1):
                out[(i, p, rank, n, -ps, -ns)] += 1
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in rows], "id long, label long, v array<double>, row string, anchor int").repartition(3)
    return Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 50 == 0, **more).collect())


def vectors(seed, n, dim, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(int(i), int(r.integers(0, 5)), list(map(float, centres[r.integers(6)] + spread * r.normal(size=dim)))) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 16, 37])
def test_negatives_equal_brute_force(spark, dim, monkeypatch):
    rows = vectors(dim, 420, dim)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)]  # copies, ties
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and want
    monkeypatch.setattr(negatives, "ROWS", 97)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "STEP", 3)
    assert mined(spark, rows) == want


def test_negatives_of_odd_rows(spark):
    rows = vectors(5, 130, 4)
    kept = rows + [(50, 3, [0.5, 0.5]), (51, 3, [0.5, 0.25]), (52, 2, [0.25, 0.25]), (100, 2, []), (101, 2, []), (150, 1, [0.0] * 4), (200, 4, [1e6, -3e7, 2e9, 4e8]), (201, 4, [1e6, -3e7, 2e9, 3e8]),
                   (202, 0, [1e6, -3e7, 2e9 / 3, 3e8]), (0, 1, [9.0, 9.0, 9.0, 9.0])]
    odd = [(300, None, [1.0] * 4), (None, 1, [1.0] * 4), (350, 1, None), (400, 1, [1.0, None, 1.0, 1.0]), (450, 1, [1.0, float("nan"), 1.0, 1.0]), (451, 1, [float("inf"), 1.0, 1.0, 1.0])]
    assert mined(spark, kept + odd + kept[:60]) == plain_negatives(kept)
    assert not mined(spark, odd) and not mined(spark, [(50, 1, [1.0])]) and not mined(spark, [])


def test_summaries_bound_the_scores():
    r = np.random.default_rng(1)
    a, b = r.integers(-300, 300, (40, 64)).astype(float) + 50, r.integers(-300, 300, (90, 64)).astype(float)
    left, right = negatives.summed(a, b)
    exact = a @ b.T
    for (m1, s1), (m2, s2) in zip(left.levels, right.levels):
        middle, rest = m1 @ m2.T, s1 @ s2.T + 1e-6
        assert (middle - rest <= exact).all() and (exact <= middle + rest).all()


# ---- phrases ---------------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in frequent.items():
            if len(g) == 2 and any(len(t) == 3 and (t[:2] == g or t[1:] == g) and 100 * b >= cover * a for t, b in frequent.items()):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return out


def texts(seed=2, n=120):
    r = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "ÉA", "x" * 50, "a", "b", "c", "😀"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "-"]
    out = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60)))
        out.append((r.choice(["en", "en", "de", None, "und"]), r.choice(["new york city ", "the of. ", ""]) * r.randint(0, 4) + text))
    return out + [("en", None), ("en", ""), ("fr", "only a few words"), (None, " \t\n"), ("de", "new york " * 6000), ("en", out[0][1]), ("en", out[0][1])]


def found_phrases(spark, rows, **more):
    df = spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, h long, fp string").repartition(3)
    return {tuple(r)[:8] for r in phrases.phrases(df, **more).collect()}


@pytest.mark.parametrize("least,cover,top", [(10, 50, 2000), (3, 20, 7), (2, 101, 40)])
def test_phrases_equal_plain_counts(spark, least, cover, top):
    rows = texts()
    want = plain_phrases(rows, least, cover, top)
    assert found_phrases(spark, rows, least=least, cover=cover, top=top) == want and want


def test_phrases_over_several_blocks_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOKENS", 40)
    rows = texts(9, 60)
    assert found_phrases(spark, rows, least=2) == plain_phrases(rows, 2, 50, 2000)
    assert found_phrases(spark, []) == set() and found_phrases(spark, [("en", None)]) == set()


def test_clashing_words_get_another_salt(spark, monkeypatch):
    """A word count whose second fingerprints differ makes the run start again with the next salt; so do texts that differ."""
    rows = texts(4, 40)
    salts, counts, read_back = [], phrases.word_counts, phrases.read_back

    def clashing(docs, salt, least):
        salts.append(salt)
        out = counts(docs, salt, least)
        return out.withColumn("c2", F.col("c1") + 1) if salt == 0 else out

    def other_texts(docs, wanted, salt):
        out = read_back(docs, wanted, salt)
        return out.union(out.withColumn("phrase", F.lit("another"))) if salt == 1 else out

    monkeypatch.setattr(phrases, "word_counts", clashing)
    monkeypatch.setattr(phrases, "read_back", other_texts)
    assert found_phrases(spark, rows, least=3) == plain_phrases(rows, 3, 50, 2000)
    assert salts == [0, 1, 2]


def test_words_that_share_a_fingerprint_are_seen():
    h, c, lang = np.array([5, 5, 5, 7], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint64), np.zeros(4, dtype=np.uint64)
    at, n = phrases.distinct([h, c, lang])
    assert sorted(zip(h[at].tolist(), c[at].tolist(), n.tolist())) == [(5, 1, 2), (5, 2, 1), (7, 1, 1)]


def test_fingerprints_give_their_parts():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    two, three = phrases.prints(h, 2), phrases.prints(h, 3)
    base = phrases.tx.BASE
    assert (two - h[:-1] * base == h[1:]).all()
    assert (three - h[:-2] * base * base == two[1:]).all() and ((three - h[2:]) * phrases.inverse(base) == two[:-1]).all()
    for a, b in itertools.product([1, 3, 10**7], [1, 10**4]):
        assert 10**6 * a * a // (b * b) >= 0


# ---- vectors of equal ids --------------------------------------------------------------------------------------------

def test_equal_vec_ids_are_different_vectors(spark):
    """Two orthogonal vectors of one id, two near copies of the first, one of the second, and a null vector of the same id."""
    from driftloom.llm import pivots

    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, "a"), (1, two, "a"), (2, [1.0, 0.01, 0.0], "a"), (3, [1.0, 0.0, 0.01], "a"), (4, [0.01, 1.0, 0.0], "a"), (1, None, "a"), (1, one, None), (None, one, "a"), (9, one, "b")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, v array<float>, label string").repartition(2)
        got = Counter(tuple(r) for r in pivots.links(df, 0.93).select("id", "n_links", "component_id").collect())
        assert got == Counter([(1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (1, 0, 1), (1, 0, 1), (None, 0, None), (9, 0, 9)])
