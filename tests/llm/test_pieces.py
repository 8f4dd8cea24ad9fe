import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from scorewatch.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def scan(m, text, chunk):
    s = m.normal(text)
    count = max(1, len(s) // chunk)
    cuts = [c * chunk for c in range(count)] + [len(s)]
    parts = [(s[max(0, a - m.longest):a], s[a:b + m.longest], b - a, c, c + 1 == count)
             for c, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    ends = pieces.boundary_states([frozenset(pieces.transfer(m, *p)) for p in parts])
    return sum((pieces.backtrace(m, p[1], p[2], f, b) for p, (f, b) in zip(parts, ends)), [])


def odd_texts(rnd):
    vocab = ["the", "thing", "internationalization", "aaaaaa", "ééé", "漢字漢字", "😀", "a", "x1y2", "....", "\n", "\t", ""]
    kinds = ["".join(rnd.choice("abcdeain ") for _ in range(600)), "a" * 500, "thethethein" * 60, "漢字かな交じり文" * 40,
             " " * 300, "  x" * 120, "abc" + " " * 90 + "def " * 60, "\n" * 120, "e" * 99 + "▁" * 40 + "nd" * 150]
    kinds += [" ".join(rnd.choice(vocab) for _ in range(150)) for _ in range(25)]
    kinds += ["".join(rnd.choice(["in", "ing", "er", "the", "a", "tion", "n"]) for _ in range(250)) for _ in range(25)]
    return kinds


def test_scan_equals_the_library(sp):
    rnd = random.Random(3)
    m = pieces.model(PATH)
    for text in odd_texts(rnd):
        want = sp.encode(text)
        for chunk in (17, 40, 128):
            assert scan(m, text, chunk) == want, (chunk, text[:60])


def test_products_are_associative():
    rnd = random.Random(4)
    mats = [frozenset(((rnd.randint(0, 3), "p"), (rnd.randint(0, 3), "p")) for _ in range(5)) for _ in range(6)]
    a, b, c = mats[:3]
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))


def test_operator_round_trips_and_equals_the_library(spark, sp):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rnd = random.Random(5)
    texts = [r.text for r in docs] + odd_texts(rnd) + [None, "", "word " * 30_000, "q" * 40_000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in pieces.encode(frame, PATH, giant=900, chunk=300).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame, PATH), PATH).collect()}
    assert back == {i: sp.decode(sp.encode(t or "")) or "" for i, t in enumerate(texts)}
    for r in pieces.round_trips(frame, PATH, giant=900, chunk=300).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.ids == ids
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_crc32 == zlib.crc32(back[r.doc_id].encode())
        assert r.round_trip == (back[r.doc_id] == (texts[r.doc_id] or ""))


def test_empty_table_and_null_ids(spark):
    assert pieces.round_trips(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = pieces.encode(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), PATH).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 300, None, 301]), (4, None), (5, [300, 301])],
                                "doc_id long, ids array<int>").coalesce(1)
    got = {r.doc_id: r.text for r in pieces.decode(odd, PATH).collect()}
    assert got[1] == got[2] == got[4] == "" and got[3] == got[5] != ""


def test_extra_columns_with_the_names_of_the_result(spark, sp):
    rows = [(7, "a word", "x", 1, 2, True), (7, "a word", "y", 1, 2, False), (8, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, decoded string, ids_crc32 int, rid int, round_trip boolean")
    got = pieces.round_trips(frame, PATH).collect()
    assert sorted((r.doc_id, r.ids, r.round_trip) for r in got) == [(7, sp.encode("a word"), True)] * 2 + [(8, [], True)]
