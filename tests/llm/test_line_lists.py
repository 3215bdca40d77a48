"""Line dedup: lists of single words and of pairs of words, in one pass or several, and what is left on disk."""

import random

import pytest

from driftloom import session
from driftloom.llm import lines
from llm import plain


def texts(seed: int) -> list[tuple[int, str]]:
    """Documents of lines over few words, so that every word is frequent, with near copies around the limit; some lines are long."""
    r = random.Random(seed)
    words, made = [f"w{i}" for i in range(60)], []
    for _ in range(260):
        n = r.choice((1, 2, 3, 4, 5, 6, 9, 10, 20, 59, 66, 90, 130))
        line = [r.choice(words) if n < 60 else f"{r.choice(words)}{r.randrange(4)}" for _ in range(n)]
        made.append(line)
        for _ in range(r.choice((0, 0, 1, 2))):
            made.append([f"X{r.randrange(50)}" if r.random() < r.choice((0.05, 0.1, 0.2)) else w for w in line])
    r.shuffle(made)
    made = [" ".join(x) for x in made]
    return [(i, "\n".join(made[i::40])) for i in range(40)]


@pytest.mark.parametrize("seldom, least", [(64, 4_000_000), (4, 4_000_000), (1, 300)])
def test_lists_of_words_and_of_pairs(spark, monkeypatch, seldom, least):
    monkeypatch.setattr(lines, "SELDOM", seldom)
    monkeypatch.setattr(lines, "PASS_LEAST", least)
    monkeypatch.setattr(lines, "PASS_ROWS", 1)
    rows = texts(seldom)
    found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain.repeated_lines(rows)
    assert {r["d"]: list(r["gone"]) for r in found} == {d: sorted(gone) for d, gone in want.items() if gone}


def test_nothing_but_the_result_stays_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "checkpoint_root", lambda _: str(tmp_path))
    gone = lines.repeated_lines(spark.createDataFrame(texts(5), "doc_id long, text string"))
    assert gone.count()
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "driftloom").iterdir()] == ["lines-gone"]
