import random


import numpy as np
import pytest


from scorewatch.llm import simhash
from scorewatch.llm.components import components
from tests.llm.brute import classes, fingerprint


def test_golay_decoding_meets_within_one_bit():
    golay = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    keys = golay.indices(words)
    counts = {(row >= 0).sum() for row in keys}
    assert counts == {1, 6}
    flipped = words ^ (1 << rng.integers(0, 23, 4000))
    probes = golay.indices(flipped)
    assert all(k[0] in p for k, p in zip(keys, probes))
    assert (np.array(golay.low)[:1] == 0).all()


def test_every_pair_within_three_bits_shares_a_key():
    golay = simhash.Golay()
    rnd = random.Random(2)
    for _ in range(1500):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            y ^= 1 << b
        row, key = simhash.keys_of(np.array([x, y], dtype=np.uint64), golay)
        assert set(key[row == 0]) & set(key[row == 1])


def test_one_error_in_every_segment_shares_a_key():
    golay = simhash.Golay()
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    y = x.copy()
    for at, n in simhash.SEGMENTS:
        y ^= np.uint64(1) << (rng.integers(0, n, len(x)) + at).astype(np.uint64)
    row, key = simhash.keys_of(np.concatenate([x, y]), golay)
    owner = row % len(x)
    mine, theirs = ({*zip(owner[side].tolist(), key[side].tolist())} for side in (row < len(x), row >= len(x)))
    assert {o for o, _ in mine & theirs} == set(range(len(x)))


def test_unrelated_fingerprints_seldom_meet():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    row, key = (np.concatenate(x) for x in zip(*(
        (r + at, k) for at in range(0, len(fps), 20_000)
        for r, k in [simhash.keys_of(fps[at:at + 20_000], simhash.Golay())])))
    assert len(key) < 52 * len(fps)
    _, n = np.unique(key, return_counts=True)
    assert (n * (n - 1) // 2).sum() < 0.01 * len(fps)


def texts():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 150))]
        for j in range(rnd.choice([1, 1, 2, 12])):
            new = list(base)
            if j % 3 and len(new) > 40:
                new[rnd.randrange(len(new))] = "changed"
            rows.append(" ".join(new).title() if j == 1 else "\t ".join(new))
    rows += [None, "", " \n ", "one", "One", "ÀB c", "àb c"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("run", [simhash.RUN, 3])
def test_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash.links, "__defaults__", (3, run))
    rows = texts()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, fingerprint(t)) for d, t in rows]
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(want)
    assert {r.doc_id: r.component_id for r in got} == classes(want)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "x y z", 3), (5, "p q r", 4), (None, "q w e", 5), (7, None, 6)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == 6
    by_fp = {}
    for r in got:
        by_fp.setdefault(r.fp, set()).add(r.component_id)
    assert by_fp[0] == {7}
    assert sorted(str(c) for v in by_fp.values() for c in v) == ["5", "5", "5", "7", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 600)] + [(1000, i) for i in range(1001, 1030)] + [(7, 7), (2000, 1999)]
    ids = list(range(3000, 3400))
    rnd.shuffle(ids)
    edges += list(zip(ids, ids[1:200])) + [(rnd.choice(ids[200:]), rnd.choice(ids[200:])) for _ in range(150)]
    label = {v: v for e in edges for v in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in edges:
        u, v = sorted((root(a), root(b)))
        label[v] = u
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in label if v in got} and len(got) >= 601 + 30 + 2 + 200
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []
