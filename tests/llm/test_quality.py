import zlib

import numpy as np

from scorewatch.llm import quality


def walk(model, x):
    """One row at a time, one tree at a time."""
    out = []
    for row in x:
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > t[i])
            total += leaf[i - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_traversal_equals_a_walk_and_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000], trees=20)
    assert np.allclose(model.score(x[:200]), walk(model, x[:200]))
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    for r in got.head(200).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    good, bad = m[m.quality == 1], m[m.quality == 0]
    assert (m.predicted == m.quality).mean() > 0.95
    assert good.predicted.mean() > 0.99
    ranks = m.score.rank()
    auc = (ranks[m.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97


def test_nulls_empty_and_single_class(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "some text", 0.5), (2, "", 0.5), (2, "x" * 200_000, 0.5)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 4 and all(r.predicted == 1 for r in got)
    ones = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score > 0.9 for r in quality.classify(docs, ones).collect()} == {True}
    assert quality.classify(docs.limit(0), ones).collect() == []


def layouts(docs):
    return docs.coalesce(1), docs.repartition(5, "text").sortWithinPartitions("n_chars")


def test_scores_do_not_depend_on_the_layout(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    one, five = (quality.classify(docs, labels.repartition(n)).toPandas().sort_values("doc_id")
                 for n, docs in zip((1, 7), layouts(spark.read.parquet(f"{d}/documents.parquet"))))
    assert np.allclose(one.score, five.score, atol=1e-9) and one.predicted.tolist() == five.predicted.tolist()


def test_keep_good_keeps_what_classify_predicts(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    want = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_statistics_against_plain_counts():
    text = "Ab, cd.\ncd! É x1 cd.\n\nAb, cd."
    got = dict(zip(quality.FEATURES, quality.statistics(text)))
    raw, words, lines = text.encode(), text.encode().split(), [x for x in text.split("\n") if x]
    assert np.isclose(got["log_chars"], np.log1p(len(raw))) and np.isclose(got["log_lines"], np.log1p(len(lines)))
    assert np.isclose(got["upper"], 2 / len(raw)) and np.isclose(got["digit"], 1 / len(raw))
    assert np.isclose(got["bangs"], 1 / len(words)) and np.isclose(got["non_ascii"], 2 / len(raw))
    assert np.isclose(got["distinct_words"], len(set(words)) / len(words))
    assert np.isclose(got["top_word"], max(map(words.count, words)) / len(words))
    assert np.isclose(got["distinct_lines"], len(set(lines)) / len(lines))
    assert np.isclose(got["distinct_pairs"], len(set(zip(words, words[1:]))) / (len(words) - 1))


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, size=(400, 3)).astype(np.float32)
    y = (x[:, 1] + rng.normal(size=400) > 7).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)

    def gain(j, cut):
        right = x[:, j] > cut
        h = [p * (1 - p) * s.sum() for s in (~right, right)]
        if min(h) < quality.MIN_HESSIAN:
            return -1.0
        return sum((p - y)[s].sum()**2 / (w + quality.L2) for s, w in zip((~right, right), h))
    best = max(gain(j, cut) for j in range(3) for cut in range(12))
    assert np.isclose(gain(model.feature[0, 0], model.threshold[0, 0]), best)
