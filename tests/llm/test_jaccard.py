import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.llm import jaccard


def set_of(t, width=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, share=85):
    sets = [set_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= share * len(a | b):
            label[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return sorted((str(d), len(s), str(best.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two three", "one\ttwo three", "a b c d", "A b c d"]
    for g in range(12):                                          # groups of near copies, chains among them
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 120, 300]))]
        for k in range(rng.choice([2, 3, 9])):
            texts.append(" ".join(words))
            words = near(rng, words, rng.choice([0, 1, 1, 2, 4]))
    hub = [rng.choice(vocab) for _ in range(150)]
    texts += [" ".join(near(rng, hub, rng.choice([0, 1, 2, 3]))) for _ in range(60)]       # one large group
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.choice([2, 4, 8, 60]))]) for _ in range(40)]
    texts += ["Same Words again and again"] * 20
    ids = rng.sample(range(5000), len(texts))
    rows = [(None if i % 29 == 0 else d, t) for i, (d, t) in enumerate(zip(ids, texts))]
    return rows + rows[20:24]


@pytest.mark.parametrize("seed, run, budget", [(1, 2048, 8), (2, 16, 1), (3, 2048, 1)])
def test_against_brute_force(spark, monkeypatch, seed, run, budget):
    monkeypatch.setattr(jaccard, "CHUNK", 3000)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {"sig": F.lit(1), "N": F.lit("n"), "key": F.lit(0), "component": F.lit(3)})
    got = jaccard.jaccard_classes(docs, run=run, budget=budget).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)


def test_the_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(203)]                         # 200 shingles
    rows = [(1, " ".join(base))]
    for k in range(25, 40):                                      # cut ends: k shingles fewer
        rows.append((k, " ".join(f"{k}x{w}" for w in base)))
        rows.append((1000 + k, " ".join(f"{k}x{w}" for w in base[:len(base) - k])))
    got = {r[0]: r[2] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(25, 40):
        assert (got[1000 + k] == k) == (100 * (200 - k) >= 85 * 200)


def test_long_text_and_pieces():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(150_000))
    assert len(jaccard.shingles(text)) == len(set_of(text))
    assert len(jaccard.shingles("a " * 100_000)) == 1


def test_orders_are_one_to_one_and_share_a_prefix_token():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(4, 200))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[int(n * 0.08):], rng.integers(0, 2**63, 2, dtype=np.uint64)])
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        for f in jaccard.MIX:
            p, q = (jaccard.prefix_under(t, int(jaccard.prefix_size(np.int64(len(t)), np.int64(len(t)), 85)), f)
                    for t in (x, y))
            assert len(np.unique(jaccard.mixed(x, f))) == len(x) and len(np.intersect1d(p, q)) > 0


def test_no_rows(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_bitmap_never_hides_a_shared_token():
    rng = np.random.default_rng(6)

    def side(t):
        b = jaccard.bitmap(t)
        return int.from_bytes(b, "little"), 8 * len(b), len(t)

    for _ in range(300):
        shared, a, b = (rng.integers(0, 2**63, int(rng.integers(0 if i else 1, 400)), dtype=np.uint64) for i in range(3))
        x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
        both = len(np.intersect1d(x, y))
        assert both <= jaccard.room(side(x), side(y)) == jaccard.room(side(y), side(x)) <= min(len(x), len(y))
    x, y = (rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2))
    assert jaccard.room(side(x), side(y)) < 400                  # unlike sets are told apart
