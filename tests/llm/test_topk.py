import math
from fractions import Fraction

import numpy as np
import pytest

from scorewatch.llm import topk


def brute(rows, k, every):
    ok = [(i, r[0], np.floor(64 * np.array(r[1], dtype=np.float32).astype(float))) for i, r in enumerate(rows)
          if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, qid, q in ok:
        if qid is None or qid % every:
            continue
        s = sorted((-int(q @ v), vid is None, vid or 0) for j, vid, v in ok if j != i and len(v) == len(q))[:k]
        out += [(qid, n + 1, None if none else vid, -sc) for n, (sc, none, vid) in enumerate(s)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>"


def test_against_brute_force_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 960)]                  # a group of copies
    rows += [(20, rng.normal(size=8).tolist()), (None, rows[3][1]), (None, rows[3][1]), (980, None), (1000, []),
             (1020, [1.0] * 7 + [float("nan")]), (1040, [float("inf")] * 8), (1060, [None] * 8), (1080, [1.0] * 5),
             (1081, [2.0] * 5), (-20, rows[5][1])]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 7, 20)
    assert got(topk.top_k(frame, k=7, every=20, shard=100, block=13)) == want
    assert got(topk.top_k(frame, k=7, every=20)) == want


def exact(rows, k, every):
    """Brute force in Python integers, scores given within a long."""
    ints = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in rows}
    out = []
    for i in ints:
        if i % every == 0:
            s = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(ints[i], v)))), j)
                       for j, v in ints.items() if j != i and len(v) == len(ints[i]))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1.0, 1e6, 3e7, 1e12, 1e200])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_scores_are_exact_at_any_size(spark, size, kind):
    rng = np.random.default_rng(5)
    if kind == "float" and size > 1e30:
        size = 1e30
    x = rng.normal(size=(300, 8)) * size * 10.0 ** rng.integers(-3, 1, (300, 8))        # fractional, mixed sizes
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert got(topk.top_k(df, k=5, every=4, shard=40, block=30)) == exact(rows, 5, 4)


def test_scores_between_two_to_the_53_and_63():
    rng = np.random.default_rng(7)
    v = np.floor(rng.normal(size=(200, 8)) * 2.0**27)
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in v]
    top = float(np.abs(v).max()) ** 2 * 8
    assert 2**53 < top < 2**62 and any(float(s) != s for row in want for s in row)
    assert topk.products(v, v, top).tolist() == want


def test_fewer_rows_than_k_empty_and_clashing_columns(spark):
    assert got(topk.top_k(spark.createDataFrame([], SCHEMA))) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 2), (3, [-1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", row int")
    assert got(topk.top_k(df)) == [(0, 1, 1, 2048), (0, 2, 3, -4096)]


def test_branch_and_bound_prunes():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(500, 4)) + 50, rng.normal(size=(4000, 4)) - 50]).round()
    tree = topk.build(v)
    best = topk.search(v, np.arange(len(v)), np.arange(len(v)), tree, np.full((1, 4), 9.0), np.array([-1]),
                       np.full(1, topk.LEAST), 5)
    s = v @ np.full(4, 9.0)
    assert sorted(best.score, reverse=True) == sorted(s, reverse=True)[:5]
