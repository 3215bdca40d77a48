"""The operators against plain versions, on small inputs with nulls, empty and long texts, ties, repeats and odd columns."""

import bisect
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from driftloom.llm import blocks, decontaminate, lines, minhash, packing, pivots, quality, scoring, substrings, token_files, toxicity
from driftloom.llm import text as tx
from llm import plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside, as further columns of the input.
CLASH = "row long, h long, block int, id string, label string, line int, text_hash string, kept boolean, n_words string, component long"


def corpus(seed=7, n=60):
    """(doc_id, text): random words, copies, near copies, shared passages, empty and null texts, a long one."""
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, rows = prose(70), []
    for i in range(n):
        kind = i % 10
        if kind == 0 or not rows:
            text = "\n".join(" ".join(prose(r.randint(1, 30))) for _ in range(6))
        elif kind == 1:
            text = rows[-1][1]
        elif kind == 2:
            w = (rows[-1][1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(prose(20) + passage + prose(15))
        elif kind == 4:
            text = " ".join(passage[5:60]) + "\n" + " ".join(prose(8))
        elif kind == 5:
            text = [None, "", " \t\n ", "one", "two words", "\n\n"][(i // 10) % 6]
        elif kind == 6:
            text = " ".join(passage * 3)
        elif kind == 7:
            text = " ".join(prose(1500)) if i == 17 else "Same short line here\n" + " ".join(prose(12))
        else:
            text = "  ".join(prose(r.randint(2, 90))) + "\r\n"
        rows.append((i, text))
    return rows


ROWS = corpus()


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, *([None] * 10 if extra else [])) for i, t in rows], "doc_id long, text string" + (", " + CLASH if extra else ""))
    return df.repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def test_kernels():
    texts = [t for _, t in ROWS]
    for pattern, marks, lower in ((plain.BLANKS, tx.BLANKS, True), (plain.LETTERS, tx.LETTERS, True), (plain.BLANKS, tx.BLANKS, False)):
        w = tx.split(pa.array(texts, pa.string()), marks, lower)
        h = tx.hashes(w)
        every = []
        for d, t in enumerate(texts):
            got = [w.word(i).decode() for i in range(w.first[d], w.first[d + 1])]
            assert got == plain.words(t, pattern, lower)
            every += got
        assert len(set(zip(every, h.tolist()))) == len(set(every)) == len(set(h.tolist()))
        for k in (1, 2, 5, 13, 50):
            runs = {}
            for i, x in enumerate(tx.rolling(h, k).tolist()):
                assert runs.setdefault(tuple(every[i:i + k]), x) == x
            assert len(set(runs.values())) == len(runs)
        text, begin = tx.joined(w)
        assert [text[a:b].tobytes().decode() for a, b in zip(begin[:-1], begin[1:])] == [" ".join(plain.words(t, pattern, lower)) for t in texts]


def test_decontamination(spark, docs):
    items = [(1, " ".join(plain.words(ROWS[3][1], lower=False)[30:60])), (2, "two WORDS"), (3, None), (4, ""), (11, ROWS[3][1]), (5, "not to be found anywhere at all")]
    found = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")), "n_words", "n_hit", "items", "contaminated")
    for i, t in ROWS:
        n, hit, ids = plain.contaminated(t, items)
        assert found[i] == (n, hit, ids, hit > 0 and 20 * hit >= n)
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in none.collect()} == {0}
    assert decontaminate.decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    left = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in found if not found[i][3]}


def test_pivot_index_recall_and_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    rows = []
    for i in range(600):
        c = centres[i % 60]
        v = c + rng.standard_normal(32) * (0.22 if i % 3 else 0.33)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 0), (602, rows[0][1], None), (603, None, 0), (604, [0.0] * 32, 0), (605, [float("nan")] * 32, 0),
             (606, [None] + [1.0] * 31, 0), (607, [1.0, 2.0], 0), (608, [], 0), (None, rows[0][1], 0), (609, [float("inf")] * 32, 0), (610, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label string").repartition(4)
    found = {r["id"]: (r["n_links"], r["component_id"]) for r in pivots.links(df, 0.93).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    groups, want = plain.Groups([g[0] for g in good]), {g[0]: 0 for g in good}
    for x, (i, v, lab) in enumerate(good):
        for j, u, other in good[:x]:
            if lab == other and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                want[i] += 1
                want[j] += 1
                groups.link(i, j)
    assert sum(want.values()) > 400
    assert all(found[i][0] <= want[i] for i in want)
    assert sum(found[i][0] for i in want) >= 0.97 * sum(want.values())
    assert found[602] == (0, 602) and found[603] == (0, 603) and found[605] == (0, 605) and found[607][0] == found[610][0] == 1
    assert found[0][1] == found[600][1] == found[601][1]
    assert pivots.links(spark.createDataFrame([], "id long, v array<float>, label string"), 0.93).count() == 0


def test_pivot_index_recall_in_a_group_of_a_third(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x[:1000] = rng.standard_normal(64) + 0.2 * rng.standard_normal((1000, 64))
    df = spark.createDataFrame([(i, [float(y) for y in v], "a") for i, v in enumerate(x)], "id long, v array<float>, label string").repartition(4)
    y = pivots.matrix(pa.array(list(x.astype(np.float32))))
    want = (y @ y.T >= 0.93).sum() - len(y)
    found = sum(r["n_links"] for r in pivots.links(df, 0.93).collect())
    assert want > 900_000 and 0.98 * want <= found <= want


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(TOKENIZER)
    odd = [(100, "İstanbul ΣΑΣ ﬁ é x<|endoftext|>y\x0bz\x01 don't we'll 12 $$"), (101, "한국어 文字 🙂🙂"), (None, "no id")]
    path = str(tmp_path / "ids")
    token_files.write(docs.select("doc_id", "text").union(frame(spark, odd, False)), path, TOKENIZER, end=1)
    stored = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    want, at = [(None, "no id"), *ROWS, *odd[:2]], 0
    for r, (i, t) in zip(stored, want, strict=True):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["ids"]) == (i, at, ids)
        at += len(ids)
    digests = by_id(token_files.digests(spark, path), "n_tokens", "ids_crc32")
    assert all(digests[r["doc_id"]] == (len(r["ids"]), zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in stored)
    token_files.write(frame(spark, []), str(tmp_path / "none"), TOKENIZER, end=1)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_lines(spark, docs):
    gone = {(r["d"]): r["gone"] for r in lines.repeated_lines(docs).collect()}
    want = plain.repeated_lines(ROWS)
    assert {i: g for i, g in gone.items()} == {i: g for i, g in want.items() if g}
    cleaned = lines.clean(docs)
    assert cleaned.columns == docs.columns
    texts = by_id(cleaned, "text")
    for i, t in ROWS:
        kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i])
        assert texts[i] == (kept,)
    assert lines.clean(frame(spark, [])).count() == 0
    # rows without an id, and rows of the same id
    more = frame(spark, [(None, "a b c"), (5, "a b c"), (5, "d e f\na b c"), (5, "d e f\na b c")])
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.clean(more).collect()).count(("None", "")) == 1


def test_substrings(spark, docs):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeats(docs).collect()}
    want = plain.removed_words(ROWS)
    assert found == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in want.items()}
    assert sum(gone > 0 for _, gone, _ in want.values()) > 10
    long = " ".join(f"x{i}" for i in range(80))
    rows = [(None, long), (3, long), (3, long), (4, long + " tail"), (3, long.replace(" ", "  "))]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.repeats(frame(spark, rows)).collect())
    assert got == [("3", 80, 0)] * 3 + [("4", 81, 80), ("None", 80, 0)]
    assert substrings.repeats(frame(spark, [])).count() == 0


def test_packing(spark, docs):
    pieces = packing.pieces(docs, TOKENIZER, 0, 128, with_ids=True)
    found = packing.pack(packing.cut(pieces, "pieces"), 128).collect()
    places = {}
    for r in found:
        assert r["length"] == len(r["ids"]) <= 128 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r["length"] for r in found)
    assert len(places) <= -(-total // 128) + 1
    each = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == sum(map(len, each.setdefault(r["doc_id"], [])))
        each[r["doc_id"]].append(r["ids"])
    assert all(len(p) == 128 for parts in each.values() for p in parts[:-1]) and set(each) == {i for i, _ in ROWS}
    made = {r["sequence_id"]: r for r in packing.sequences(packing.pack(packing.cut(pieces, "pieces"), 128)).collect()}
    assert sum(len(r["ids"]) for r in made.values()) == total
    assert packing.packed_documents(frame(spark, []), TOKENIZER, 128).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    def least(items, size):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for room in sorted({b for b in bins if b >= items[i]}):
                at = bins.index(room)
                go(i + 1, bins[:at] + [room - items[i]] + bins[at + 1:])
            go(i + 1, bins + [size - items[i]])

        go(0, [])
        return best[0]

    r = random.Random(2)
    for _ in range(150):
        items = sorted((r.randint(1, 19) for _ in range(r.randint(1, 10))), reverse=True)
        counts = {s: items.count(s) for s in items}
        made = packing.plan(counts, 20)
        assert sorted((x for f, k in made.used for x in f * k), reverse=True) == items
        assert made.bound <= made.sequences == least(items, 20)


def test_no_plan_needs_more_sequences_than_best_fit_decreasing():
    def plain_best_fit(items, size):
        rooms, n = [], 0
        for x in sorted(items, reverse=True):
            at = bisect.bisect_left(rooms, x)
            n += at == len(rooms)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else size) - x)
        return n

    r = random.Random(1)
    cases = [[700] * 700 + [r.randint(1, 2047) for _ in range(1400)], [r.randint(1, 2047) for _ in range(2000)], [r.randint(500, 700) for _ in range(2000)]]
    cases += [[r.randint(1, 300) if r.random() < 0.5 else r.choice((100, 333, 700, 1024, 1500)) for _ in range(r.randint(0, 600))] for _ in range(20)]
    for items in cases:
        counts = {s: items.count(s) for s in set(items)}
        first, made = packing.best_fit(counts, 2048), packing.plan(counts, 2048)
        for used in (first, made.used):
            assert sorted(x for f, k in used for x in f * k) == sorted(items) and all(sum(f) <= 2048 for f, _ in used)
        assert sum(k for _, k in first) == plain_best_fit(items, 2048) >= made.sequences >= made.bound


def test_toxicity():
    r = random.Random(1)
    bad, fine = ["vexilor", "vexigan", "trolmek"], [f"ord{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(500):
        w = [r.choice(fine) for _ in range(r.randint(1, 90))]
        if i % 4 == 0:
            w.insert(r.randrange(len(w) + 1), r.choice(bad).upper() + "!")
        texts.append(" ".join(w))
        toxic.append(i % 4 == 0)
    network = toxicity.fit(texts[:350], np.array(toxic[:350]))
    scores = toxicity.sigmoid(toxicity.worst_windows(network, pa.array(texts[350:])))
    assert np.mean((scores >= 0.7) == np.array(toxic[350:])) > 0.95
    long = " ".join(r.choice(fine) for _ in range(9000))
    far = toxicity.sigmoid(toxicity.worst_windows(network, pa.array([long + " vexilor " + long, long, "", None])))
    assert far[0] > far[1] and far[0] >= 0.7 and far[2] == far[3]


def test_toxicity_gradients():
    network = toxicity.Network(3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    w = tx.split(pa.array(["some bad words here and now", "a fine day"]), tx.LETTERS)
    bucket, grams, first, back, _ = toxicity.word_inputs(w, tx.hashes(w))
    _, start, length = toxicity.windows_of(w)
    steps, places = np.arange(toxicity.WINDOW)[:, None], np.append(back, len(bucket))
    place = np.where(steps < length, places[np.minimum(start + steps, len(places) - 1)], len(bucket))
    y = np.array([1.0, 0.0])

    def loss():
        z = network.logits(place, network.features(bucket, grams, first))
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    g = network.gradients(place, network.features(bucket, grams, first), bucket, grams, first, lambda z: toxicity.sigmoid(z) - y)
    for name, values in network.w.items():
        for at in map(tuple, np.argwhere(np.abs(g[name]) > 1e-6)[:4]):
            kept = values[at]
            values[at] = kept + 1e-3
            up = loss()
            values[at] = kept - 1e-3
            down = loss()
            values[at] = kept
            assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3


def test_toxicity_frames(spark, docs):
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2, 1) for i, _ in ROWS] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.accepted(frame(spark, []), labels).count() == 0
    assert toxicity.accepted(docs, labels.where("toxic = 0")).count() == len(ROWS)


def test_toxicity_is_fitted_to_one_text_for_each_labelled_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic.tolist())))
    monkeypatch.setattr(toxicity, "SAMPLE", 2)
    docs = frame(spark, [(i, f"text {i} {k}") for i in range(9) for k in range(40 if i == 3 else 1)], False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9) for _ in range(7)], "doc_id long, toxic int")
    toxicity.fit_on(docs, labels, held=-1)
    toxicity.fit_on(docs.repartition(5), labels, held=-1)
    (texts, toxic), again = seen
    assert again == (texts, toxic) and len({t.split()[1] for t in texts}) == len(texts) == 6 and sum(toxic) == 2
    everything = toxicity.fit_on(docs.where("doc_id = 3"), labels.where("doc_id = 3"), held=-1)
    assert everything is None and len(seen[-1][0]) == 1


def not_here(fit, here=os.getpid()):
    """`fit`, but not in this process."""
    def checked(*args):
        assert os.getpid() != here
        return fit(*args)
    return checked


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    docs = frame(spark, [(i, f"{'vile' if i % 2 else 'kind'} words {i}") for i in range(60)], False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    alike = toxicity.fit_in_task(docs, labels.where("toxic = 0"))
    assert set(toxicity.worst_windows(alike, pa.array(["vile", "kind"]))) == {0.0}
    assert toxicity.fit_in_task(docs.limit(0), labels).w["out"].any() == False  # noqa: E712
    here = toxicity.fit_on(docs, labels)
    monkeypatch.setattr(toxicity, "fit", not_here(toxicity.fit))
    there = toxicity.fit_in_task(docs, labels)
    assert here.w.keys() == there.w.keys() and all(np.allclose(here.w[k], there.w[k], atol=1e-4) for k in here.w)


def test_pipeline_does_not_fit_on_the_driver(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = frame(spark, [(i, f"{'vile' if i % 2 else 'kind'} words {i}") for i in range(60)], False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "fit", not_here(toxicity.fit))
    assert 30 <= corpus_pipeline.toxic(spark, docs, str(tmp_path)).count() <= 60


def test_quality(spark, docs):
    r = random.Random(4)
    grammar = [["the", "a"], ["red", "old", "small"], ["dog", "tree", "house"], ["sees", "has"], ["the", "a"], ["ball", "road"]]
    rows = [(i, " ".join(r.choice(c) for _ in range(r.randint(3, 9)) for c in grammar), "en" if i % 2 else None) for i in range(300)]
    rows += [(i, " ".join(f"{r.random():.5f}" for _ in range(30)), "en") for i in range(300, 330)] + [(330, None, "en"), (None, "the red dog", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    assert len(found) == len(rows)
    assert not any(found[i]["kept"] for i in range(300, 330)) and np.mean([found[i]["kept"] for i in range(300)]) > 0.97
    # shares of a context add up to one
    grams = quality.trusted_bigrams(df.where("doc_id < 200").select("doc_id", "text"))
    entries, rest = quality.model(grams)
    rows = entries.collect()
    share = {r["key"]: r["a"] for r in rows if r["kind"] == 1}
    left = {r["key"]: r["b"] for r in rows if r["kind"] == 1}
    assert abs(sum(share.values()) + rest["unseen"] - 1) < 1e-9
    arcs = {r["key"]: r["a"] for r in rows if r["kind"] == 2}
    context = {r["key"]: r["context"] for r in grams.collect()}
    for c in set(context.values()) & set(left):
        assert abs(sum(a for k, a in arcs.items() if context[k] == c) + left[c] - 1) < 1e-9
    none = quality.judge(df, labels.where("quality = 0"))
    assert {r["kept"] for r in none.collect()} == {True}


def zipf_text(r, k, words, prefix):
    return " ".join(f"{prefix}{int(words * r.random() ** 3)}" for _ in range(k))


def test_quality_writes_no_copy_of_the_corpus(spark, monkeypatch):
    """Blocks are built for their n-grams and again to be scored; a block that is not the one that asked ends the run."""
    names, written = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df, name: names.append(name) or written(df, name))
    r = random.Random(3)
    docs = spark.createDataFrame([(i, zipf_text(r, 30, 300, "w"), "en") for i in range(240)] + [(None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs.repartition(3, "doc_id"), labels).count() == 241
    assert "perplexities" in names and "ngram-blocks" not in names
    rows = blocks.documents(docs.coalesce(1), F.lit(False))
    first, again, other = (blocks.write_blocks(x, sealed=True).select("block").collect() for x in (rows, rows, rows.where("doc_id > 3")))
    assert first == again and first != other


def test_quality_keeps_good_documents_without_labels(spark):
    r = random.Random(8)
    rows = [(i, zipf_text(r, 60, 4000, "w"), "en") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = by_id(quality.judge(df, labels), "kept")
    assert np.mean([found[i][0] for i in range(400, 800)]) > 0.95


def test_quality_of_a_language_with_few_labels(spark):
    r = random.Random(9)
    rows = [(i, zipf_text(r, 40, 60, "w"), "en") for i in range(1300)] + [(i, zipf_text(r, 40, 4000, "v"), "es") for i in range(1300, 1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(1300), *range(1300, 1312)]], "doc_id long, quality int, toxic int")
    assert 0 < quality.good_ids(labels.where("doc_id >= 1300"), held=True).count() < 4
    found = by_id(quality.judge(df, labels), "kept")
    assert np.mean([found[i][0] for i in range(1312, 1400)]) > 0.8


@pytest.mark.parametrize("order", [2, 3])
def test_scoring(spark, docs, order):
    found = {r["doc_id"]: r for r in scoring.score_documents(docs, 7, 2, order=order).collect()}
    mu, ends = scoring.STRENGTH, "</end>"
    tokens = {i: [*plain.words(t), ends] for i, t in ROWS}
    learned = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = {}
    for i in learned:
        past = ["<s>"] * (order - 1) + tokens[i]
        for j in range(len(tokens[i])):
            for n in range(1, order + 1):
                gram = tuple(past[order - 1 + j - n + 1:order + j])
                counts[gram] = counts.get(gram, 0) + 1
    total, kinds = sum(v for k, v in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)
    for i, w in tokens.items():
        score = base = 0.0
        past = ["<s>"] * (order - 1) + w
        for j, x in enumerate(w):
            p = (counts.get((x,), 0) + 1) / (total + kinds + 1)
            base += np.log10(p)
            for n in range(2, order + 1):
                gram = tuple(past[order - 1 + j - n + 1:order + j])
                state = len(learned) if set(gram[:-1]) == {"<s>"} else counts.get(gram[:-1], 0)
                p = (counts.get(gram, 0) + mu * p) / (state + mu)
            score += np.log10(p)
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learned, len(w), sum((x,) in counts for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6
    assert scoring.score_documents(frame(spark, []), 7, 2).count() == 0


def test_minhash(spark, docs):
    for size, percent in ((3, 85), (5, 80)):
        found = by_id(minhash.groups(docs, size, percent), "n_shingles", "component_id")
        assert found == plain.similar_groups(dict(ROWS), size, percent)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    more = frame(spark, [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "A b  c d"), (3, "")])
    got = sorted(map(str, (tuple(r) for r in minhash.groups(more, 3, 85).collect())))
    assert got == sorted(map(str, [(None, 2, None), (None, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7), (3, 0, 3)]))
    assert minhash.groups(frame(spark, []), 3, 85).count() == 0


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_minhash_misses_few_pairs_at_the_wanted_similarity(spark, size, percent):
    row = minhash.signatures(frame(spark, [(1, "a b c d e f")], False), size, minhash.side_of(percent)).first()
    one = 1 - (percent / 100) ** minhash.ROWS
    assert len(row["left"]) == len(row["right"]) and 1 - (1 - one ** len(row["left"])) ** 2 <= 0.001


def test_near_copies_of_one_document_are_one_group(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    found = by_id(minhash.groups(frame(spark, rows), 3, 85), "n_shingles", "component_id")
    assert found == plain.similar_groups(dict(rows), 3, 85)


def test_two_texts_of_one_id_link_by_themselves(spark):
    r = random.Random(4)
    one, two = ([f"{x}{r.randrange(10**6)}" for _ in range(200)] for x in "pq")
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1:]])
    rows = [(7, " ".join(one)), (7, " ".join(two)), (8, near(one, 50)), (9, near(two, 90)), (3, near(two, 10)), (12, near(one, 120))]
    want = [(3, 3), (7, 3), (7, 7), (8, 7), (9, 3), (12, 7)]
    for order in (rows, rows[::-1]):
        found = minhash.groups(frame(spark, order), 3, 85).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, found)) == want


def test_prefixes_lose_no_pair_of_sets_between_components(spark):
    r = random.Random(13)
    rows, base = [], [r.randrange(10**9) for _ in range(100)]
    for i in range(160):
        own = set(base[:r.choice((40, 90, 100))]) if i % 4 else {r.randrange(40) for _ in range(r.randint(1, 12))}
        for x in r.sample(sorted(own), min(len(own), r.randint(0, 16))):
            own.remove(x)
            own.add(r.randrange(10**9))
        rows.append((i, len(own), i % 9 if i % 3 else 0, sorted(own)))
    df = spark.createDataFrame(rows, "id long, n long, component long, shingles array<long>")
    for percent in (80, 85):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2]
                and 100 * len(set(a[3]) & set(b[3])) >= percent * len(set(a[3]) | set(b[3]))}
        found = minhash.apart(df, percent)
        assert want and {tuple(x) for x in minhash.verified(found, df, percent).collect()} == want
    assert minhash.apart(df.limit(0), 85).count() == 0


def test_copies_that_are_alike_but_not_enough_give_no_rows(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        own = {k: k for k in range(100)}
        for k in r.sample(range(100), 14):
            own[k] = r.randrange(10**9) + 1000
        rows.append((i, 100, i, sorted(own.values())))
    df = spark.createDataFrame(rows, "id long, n long, component long, shingles array<long>")
    assert minhash.apart(df, 85).count() == 0
