import math
import zlib
from collections import Counter

import numpy as np
import pytest

from scorewatch.llm import hmm


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_base(rows):
    words = {i: [*lower(t).encode().split(), b""] for i, (_, t) in enumerate(rows)}
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for i, (d, _) in enumerate(rows)}
    c = Counter(w for i, (d, _) in enumerate(rows) if d is not None and not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    return c, {i: (rows[i][0], held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n,
                   sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[i])) for i in words}


def close(a, b):
    return abs(a - b) <= 1e-6 * max(1, abs(b))


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    got = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in got] + [(None, "The of"), (1000, None), (1001, " \n"), (1001, "unheardof WORD")]


def test_base_scores_and_exact_likelihood(spark, corpus):
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(corpus)], SCHEMA + ", row int")
    rows = frame.select("doc_id", "text")
    counts = hmm.token_counts(rows)
    cls = hmm.classes_of(counts)
    model = hmm.baum_welch(hmm.coded(rows, cls).cache(), cls, states=3, rounds=1)
    c, base = brute_base(corpus)
    assert dict(zip(cls.frequent, cls.counts)) == {t: c[t] for t in cls.frequent}
    assert cls.total == sum(c.values()) and cls.distinct == len(c)

    got = hmm.score_texts(frame, states=3, rounds=1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3))
                  for r in got) == sorted((str(b[0]), *b[1:5], round(b[5], 3)) for b in base.values())

    # every token's own emission probability, the plain forward recursion, no classes, no scaling
    number = {t: i for i, t in enumerate((*cls.frequent, b""))}
    mass = Counter()
    for w, n in c.items():
        if w not in number:
            mass[cls.bucket(w)] += n + 0.1
    def emission(w):
        if w in number:
            return model.emit[number[w]]
        k = cls.bucket(w)
        return model.emit[k] * (c[w] + 0.1) / (mass[k] + 0.1)
    short = [(d, t) for d, t in corpus if len((t or "").split()) < 60]
    assert len(short) > 10
    scores = {}
    for r in got:
        scores.setdefault((r.doc_id, r.n_tokens), []).append(r.score)
    for d, t in short:
        words = [*lower(t).encode().split(), b""]
        a = model.first * emission(words[0])
        for w in words[1:]:
            a = (a @ model.move) * emission(w)
        assert any(close(s, math.log10(a.sum())) for s in scores[d, len(words)])
    known = sum(emission(w) for w in set(c) | {b""})
    unknown = sum(model.emit[len(cls.frequent) + 1 + b] * 0.1 / (mass[len(cls.frequent) + 1 + b] + 0.1)
                  for b in range(hmm.BUCKETS))
    assert np.allclose(known + unknown, 1)


def test_expected_counts_against_full_enumeration():
    rng = np.random.default_rng(2)
    model = hmm.HMM(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 4, 2).T)
    docs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 5, 3, 5, 2)]
    exp = hmm.Expected(4, 2)
    exp.add(model, docs)
    first, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for i, d in enumerate(docs):
        paths, weights = [], []
        for z in np.ndindex(*(2,) * len(d)):
            p = model.first[z[0]] * model.emit[d[0], z[0]]
            for t in range(1, len(d)):
                p *= model.move[z[t - 1], z[t]] * model.emit[d[t], z[t]]
            paths.append(z)
            weights.append(p)
        assert close(hmm.likelihood(model, docs)[i], math.log10(sum(weights)))
        for z, p in zip(paths, np.array(weights) / sum(weights)):
            first[z[0]] += p
            for t, k in enumerate(z):
                emit[d[t], k] += p
                if t:
                    move[z[t - 1], k] += p
    assert np.allclose(exp.first, first, atol=1e-4) and np.allclose(exp.move, move, atol=1e-4)
    assert np.allclose(exp.emit, emit, atol=1e-4)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score_texts(docs).toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert got.score.sum() > got.base_score.sum()


def test_without_training_rows(spark):
    got = hmm.score_texts(spark.createDataFrame([(None, "a b")], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(3, 0, 0, 0.0)]
    assert hmm.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = hmm.score_texts(docs.coalesce(1)).toPandas().sort_values("doc_id")
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 5_000)              # a long text is a batch of its own
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 20_000)
    cut = docs.repartition(5, "text").sortWithinPartitions("n_chars").withColumnRenamed("source", "SEQ")
    again = hmm.score_texts(cut).toPandas().sort_values("doc_id")
    assert np.allclose(whole.score, again.score, rtol=1e-6)
    assert np.allclose(whole.base_score, again.base_score, rtol=1e-12)


def test_profiles_and_centres():
    docs = [np.array([0, 0, 1, 400], np.uint16), np.array([300], np.uint16)]
    x = hmm.profiles(docs, own=200)
    want = np.zeros(2 * hmm.FOLD + 1)
    want[[0, 1, hmm.FOLD + 1 + (400 - 200) % hmm.FOLD]] = np.sqrt([0.5, 0.25, 0.25])
    assert np.allclose(x[0], want) and np.isclose((x[1]**2).sum(), 1)
    rng = np.random.default_rng(3)
    y = rng.normal(size=(500, 5)) * [5, 1, 1, 1, 1]
    c = hmm.first_centres(500, y.sum(axis=0), y.T @ y, 4)
    assert np.allclose(np.abs(c[0] - c[1])[0], 2 * y[:, 0].std(), rtol=0.05)
    assert hmm.nearest(c, c).tolist() == [0, 1, 2, 3]
