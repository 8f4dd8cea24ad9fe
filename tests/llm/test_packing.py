import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorewatch.llm import packing
from scorewatch.llm.tokens import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


HARD_TEXTS = [None, "", " ", "  two  spaces ", "a\n b \n\nc\td", "it's I'LL they've", "x " * 50, "tail ",
              "é ü ñ 漢字 かな 😀 mixed 12345 3.14", "<|endoftext|> inside <|endoftext|>", "a b   c",
              "\r\n line \r\n", "'s 's", "_under_score__ ##$$%%", "a.b,c!d?e"]


def test_ids_equal_the_library_on_hard_texts():
    rnd = random.Random(5)
    alphabet = "ab é'st \n\t.,1  漢 "
    texts = HARD_TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    bpe = byte_bpe(PATH)
    for t, want in zip(texts, reference_ids(texts)):
        assert bpe.encode(t or "") + [1] == want, repr(t)


def brute(pos, pen, size):
    cost = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                pad = 0 if n & (n - 1) == 0 and n >= size // 8 else size - n
                c = cost[i] + pad + pen[j] + packing.OPEN_COST
                cost[j] = c if cost[j] is None else min(cost[j], c)
    return cost[-1]


def test_cuts_are_optimal():
    rnd = random.Random(6)
    for _ in range(300):
        size = rnd.choice([16, 64])
        pos = np.cumsum([0] + [rnd.randint(1, size // 2) for _ in range(rnd.randint(1, 40))])
        pen = [0] + [rnd.choice([0, 4, 24]) for _ in pos[1:]]
        cuts, cost = packing.best_cuts(pos.tolist(), pen, packing.unpadded(pos, size), size)
        assert cost == brute(pos.tolist(), pen, size)
        assert all(pos[b] - pos[a] <= size for a, b in zip(cuts, cuts[1:]))


def check(rows, texts, size=2048):
    ids = defaultdict(list)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = reference_ids(texts)
    assert set(by_doc) == set(range(len(texts)))
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == want[d]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        for r in own:
            assert r.doc_tokens == len(want[d]) and r.length == len(r.ids) > 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding, sum(map(len, want))


@pytest.mark.parametrize("block", [packing.BLOCK, 5000])
def test_pieces_cover_every_id_once(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = HARD_TEXTS + [r.text for r in docs] + ["word" * 9000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    padding, total = check(packing.pack(frame, PATH, block=block).collect(), texts)
    if block == packing.BLOCK:
        assert padding < 0.005 * total + 2 * 2048


def test_order_is_preserved(spark):
    frame = spark.createDataFrame([(i, f"text number {i}. " * 40) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(frame.coalesce(1), PATH, with_ids=False).collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    assert [(r.doc_id, r.start) for r in rows] == sorted((r.doc_id, r.start) for r in rows)


def test_empty_null_ids_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a", 1), (None, "a", 2), (3, None, 3)],
                                              "doc_id long, text string, sequence_id int"), PATH).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("3", 1), ("None", 2), ("None", 2)]
