import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def features(t, gram):
    w = words(t)
    return [" ".join(w[i:i + gram]) for i in range(len(w) - gram + 1)]


def brute(rows, target, gram=1, buckets=10_000, percent=10, least=20, seed=2024):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        for f in features(x, gram):
            s[code(f)] += 1
    for x in target:
        for f in features(x, gram):
            t[code(f)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + buckets) / ((s[i] + 1) * (t.sum() + buckets))))
            for i in range(buckets)]
    out = []
    for d, x in rows:
        f = features(x, gram)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[code(y)] for y in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(words(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def made(n):
    rows = []
    for i in range(n):
        text = None if i % 17 == 3 else "" if i % 19 == 0 else " ".join(
            f"{'Wort' if i % 2 else 'word'}{(i * k) % 7}é-x{k % 5}" for k in range(i % 40 + 3))
        rows.append((None if i % 23 == 5 else i * 31 % 997, text))
    return rows


@pytest.mark.parametrize("percent, gram", [(10, 1), (50, 2), (100, 1), (0, 1)])
def test_against_brute_force(spark, percent, gram):
    rows = made(200) + [(900, "same Words " * 30)] * 9 + [(None, "same Words " * 30)] * 9      # repeated rows tie
    target = ["word1éx2 target words", None, "", "wort3é wort5é x4"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns(
        {"row": F.lit(1), "SCORE": F.lit("s"), "rank": F.lit(0), "block": F.lit(3)})
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, goal, percent=percent, gram=gram)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, gram=gram, percent=percent)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Éa b-c " * 200 + "w" * 500 + " end"
    whole = {g: resample.buckets_of(text, g) for g in (1, 3)}
    monkeypatch.setattr(resample, "PIECE", 37)
    for g, (n, codes) in whole.items():
        m, again = resample.buckets_of(text, g)
        assert m == n == len(words(text)) and again.tolist() == codes.tolist()
        assert codes.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in features(text, g)]


def test_bisection_finds_the_cutoff(spark):
    values = [5, 5, 5, -3, 2**62, -2**62, 0, 7, 7, 1]
    rows = spark.createDataFrame([(v,) for v in values], "k long")
    for wanted in range(1, 11):
        v = sorted(values, reverse=True)[wanted - 1]
        assert resample.bisect(rows, "k", wanted) == (v, sum(x > v for x in values))


def test_no_rows_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    got = sorted(map(tuple, resample.resample(some, none, percent=100).collect()))
    assert got == brute([(1, "a b " * 20), (2, None)], [], percent=100)
