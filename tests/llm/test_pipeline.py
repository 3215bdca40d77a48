"""The pipeline's stages one after the other against plain versions."""

import random

import pyarrow as pa

import corpus_pipeline
from driftloom.llm import toxicity
from llm import plain
from llm.test_operators import ROWS


def plain_run(rows, network, items):
    """doc_id to text after each filtering stage."""
    logits = toxicity.worst_windows(network, pa.array([t for _, t in rows], pa.string()))
    kept = {i: t for (i, t), s in zip(rows, toxicity.sigmoid(logits)) if s < toxicity.THRESHOLD}
    after = [dict(kept)]
    gone = plain.repeated_lines(kept.items())
    kept = {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in kept.items()}
    after.append(dict(kept))
    groups = plain.similar_groups(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    after.append(dict(kept))
    found = {i: plain.contaminated(t, items) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not (found[i][1] and 20 * found[i][1] >= found[i][0])}
    return [*after, kept]


def test_stages(spark, tmp_path):
    r = random.Random(5)
    bad = [(1000 + i, " ".join(r.choice(["vexilor", "trolmek"]) if j % 9 == 4 else f"ord{r.randrange(300)}" for j in range(60))) for i in range(120)]
    fine = [(2000 + i, " ".join(f"ord{r.randrange(300)}" for _ in range(60))) for i in range(240)]
    same = [f"zeta{r.randrange(500)}" for _ in range(77)]  # the same words, broken into other lines
    broken = [(3000 + k, "\n".join(" ".join(same[j:j + k]) for j in range(0, 77, k))) for k in (7, 11, 30)]
    rows = [*ROWS, *bad, *fine, *broken]
    items = [(1, " ".join(plain.words(fine[0][1])[10:40])), (2, "nothing of this is there")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = toxicity.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = plain_run(rows, network, items)
    assert len(rows) - 150 < len(want[0]) < len(rows) - 90, [len(x) for x in want]
    assert len(want[3]) < len(want[2]) < len(want[1]), [len(x) for x in want]
    columns = docs.columns
    for k, ((name, stage), texts) in enumerate(zip(corpus_pipeline.STAGES, want)):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == columns
        assert {x["doc_id"]: x["text"] for x in docs.collect()} == texts, name
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {x["doc_id"] for x in packed} == set(want[3]) and all(x["length"] <= 2048 for x in packed)
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)
