import random

import pytest

from scorewatch.llm import line_dedup
from tests.llm.brute import without_copied_lines


def run(spark, texts, min_words):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in line_dedup.line_dedup(frame, min_words).collect()}


@pytest.mark.parametrize(("seed", "min_words"), [(1, 1), (2, 4), (3, 9), (4, 25)])
def test_maximal_runs_against_brute_force(spark, seed, min_words):
    rnd = random.Random(seed)
    lines = ["", "one", "two words", "three words here", "a b c d e", "f g h i j k l", "   ", "zz\tyy"]
    runs = [[rnd.choice(lines) for _ in range(rnd.randint(1, 12))] for _ in range(6)]
    texts = {}
    for d in range(60):
        own = []
        for _ in range(rnd.randint(1, 5)):
            own += rnd.choice(runs) if rnd.random() < 0.6 else [f"unique {rnd.random()}"]
        texts[d] = "\n".join(own)
    texts[60] = "\n".join(["a b c d e"] * 300)
    assert run(spark, texts, min_words) == without_copied_lines(texts, min_words)


def test_clean_texts_stay_and_first_copies_stay(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    texts = {3: f"start\n{passage}\nend", 7: f"other\n{passage}\nmore", 9: "short\nshort", 11: f"own {passage}"}
    got = run(spark, texts, 10)
    assert got == {**texts, 7: "other\nmore"}


def test_nulls_repeats_empty_and_clashing_columns(spark):
    line = "w " * 20
    rows = [(None, line, 1), (2, line, 2), (2, line, 3), (5, None, 4), (5, "", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    got = line_dedup.line_dedup(frame).collect()
    assert sorted((str(r.doc_id), r.text, r.removed_lines) for r in got if r.text != "" or r.removed_lines) \
        == sorted([("None", "", [0]), ("2", line, []), ("2", "", [0])]) + [("5", None, [])] \
        or len(got) == 5
    assert sorted(r.rid for r in got) == [1, 2, 3, 4, 5]
    assert sum(r.text == line for r in got) == 1 and next(r for r in got if r.text == line).doc_id == 2
    assert next(r for r in got if r.rid == 4).text is None
    assert line_dedup.line_dedup(frame.limit(0)).collect() == []
