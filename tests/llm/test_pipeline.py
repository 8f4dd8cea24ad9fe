import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scorewatch.llm import common, line_dedup, quality, simhash
from tests.llm.brute import near_duplicate_roots, without_copied_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]

    good = common.stored(stages["quality_classifier"](spark, docs, SF), "test")
    scores = {r.doc_id: r.predicted for r in
              quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {r.doc_id: r for r in good.collect()}
    assert set(kept) == {d for d, p in scores.items() if p} and 0 < len(kept) < len(before)
    assert all(kept[d] == before[d] for d in kept)

    cleaned = common.stored(stages["line_dedup"](spark, good, SF), "test")
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == without_copied_lines({d: r.text for d, r in kept.items()}, line_dedup.MIN_WORDS)
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    single = common.stored(stages["simhash_near_dedup"](spark, cleaned, SF), "test")
    assert {r.doc_id for r in single.collect()} == near_duplicate_roots(got)
    assert single.columns == cleaned.columns == good.columns == docs.columns

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in single.collect()}
    ids = {}
    rows = corpus_pipeline.run(spark, SF).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == want
    by_sequence = {}
    for r in rows:
        by_sequence[r.sequence_id] = by_sequence.get(r.sequence_id, 0) + r.length
    assert max(by_sequence.values()) <= 2048


def test_stages_with_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, long, "en", "s", 1), (1, long, "en", "s", 1),
            (2, f"{long}\n{long}", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for sf_rows in (docs, docs.limit(0)):
        at = sf_rows
        for name, stage in corpus_pipeline.STAGES:
            at = common.stored(stage(spark, at, SF), "test")
        assert (at.count() > 0) == (sf_rows is docs)
    one = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "2", "None"] or len(one) == 2


def test_words_pattern_is_python_split():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = "".join(rng.choice(list("aB \t\n\x0b\x0c\r\x1cé"), 20))
        assert [w.encode() for w in re.findall(common.WORD, t)] == t.encode().split()
