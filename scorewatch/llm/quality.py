"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a short vector of statistics (``FEATURES``: shares of
character classes, words, lines, repetition). Labels, ids, language and source
are never inputs. The trees are fitted on labelled rows whose id's CRC-32 is not
divisible by ``FOLDS``; of these at most about ``MAX_TRAIN`` enter, chosen by a
hash of the id (the documented bound of the fit; a model with some hundred leaves
gains nothing from more) and taken in the order of id and statistics, so the trees
do not depend on how the rows are stored. Values are cut into ``BINS``
quantile bins, splits come from gradient and hessian histograms, trees have a
fixed depth, so the model is three flat arrays (feature, threshold, leaf) and a
batch walks all trees at once, level by level, with numpy indexing.

Statistics and scores are computed per Arrow batch in the tasks that hold the
rows; the chosen ids, bounded as they are, are broadcast. ``keep_good`` measures the
labelled rows for the fit and every row once for its score.

Defined cases: a null text counts as empty (all statistics zero) and gets a score;
a null doc_id is not held out and never learned from; several labels of one id
are averaged and rounded; null labels are ignored; with no labels, or only one
kind, every score is the labels' mean (0.5 without any); an empty table gives no
rows; repeated rows are scored each and learned from once; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import python_tasks, sampled, stored, table

FOLDS = 5
MAX_TRAIN = 30_000
THRESHOLD = 0.3
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
L2 = 1.0
MIN_HESSIAN = 2.0

FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "digit", "space", "newline", "stop_marks",
    "commas", "bangs", "symbols", "pipes", "non_ascii", "distinct_words", "top_word", "distinct_lines",
    "line_words", "closed_lines", "short_lines", "upper_words", "marked_words", "distinct_pairs", "vowels",
)


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


UPPER = _class(bytes(range(65, 91)))
DIGIT = _class(b"0123456789")
SPACES = _class(b" \t\x0b\x0c\r")
STOPS = _class(b".?")
COMMAS = _class(b",;:")
SYMBOLS = _class(b"#$%&*+/<=>@[\\]^_`{}~")
VOWELS = _class(b"aeiouAEIOU")


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w, m = max(1, len(words)), max(1, len(lines))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / w,
        hist[UPPER].sum() / n, hist[DIGIT].sum() / n, hist[SPACES].sum() / n, hist[10] / n, hist[STOPS].sum() / w,
        hist[COMMAS].sum() / w, hist[33] / w, hist[SYMBOLS].sum() / w, hist[124] / w, hist[128:].sum() / n,
        len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / m,
        len(words) / m, sum(x[-1:] in b".!?" for x in lines) / m, sum(len(x) < 40 for x in lines) / m,
        sum(x.isupper() for x in words) / w, sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w,
        pairs / max(1, len(words) - 1), hist[VOWELS].sum() / n,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every document."""
    python_tasks(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], dtype=np.float32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


# ---- trees --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Complete binary trees in flat arrays: node i has children 2i + 1 and 2i + 2."""

    base: float                   # log-odds before the first tree
    feature: np.ndarray           # (trees, inner nodes)
    threshold: np.ndarray         # (trees, inner nodes): right if the value is larger
    leaf: np.ndarray              # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            node = np.zeros((len(x), trees), dtype=np.int64)
            tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            while (node[:1] < inner).all() and len(x):
                right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            if len(x):
                total += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        bins: int = BINS) -> Trees:
    """Logistic gradient boosting from histograms."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(k) * bins
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first) * (k * bins))[:, None] + flat
            g = np.bincount(at.ravel(), np.repeat(grad, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            h = np.bincount(at.ravel(), np.repeat(hess, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g)**2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(h < MIN_HESSIAN) | (ht - h < MIN_HESSIAN)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, cut = divmod(int(best[i]), bins)
                if gain[i, j, cut] > 1e-9:
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        end = node - inner
        leaf[t] = -rate * np.bincount(end, grad, leaves) / (np.bincount(end, hess, leaves) + L2)
        total += leaf[t, end]
    return Trees(base, feature, threshold, leaf)


# ---- operator -----------------------------------------------------------------------------

def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % folds == 0, F.lit(False))


def chosen_labels(labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, y) of at most about ``max_rows`` labelled ids that are not held out."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label_col)).alias("y")))
    known = stored(known.filter(~held_out()), "quality-labels")
    return known.filter(sampled(max_rows, known.count(), "doc_id"))


def train(rows: DataFrame, chosen: DataFrame) -> Trees:
    """Fit on the rows of ``rows(doc_id, x)`` whose id is ``chosen``."""
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").distinct()
    got = found.orderBy("doc_id", "x").toPandas()
    x = np.stack(got["x"]).astype(np.float32) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, got["y"].to_numpy(dtype=float))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of ``rows(doc_id, x)``."""
    def run(batches):
        for b in batches:
            col = b.column(1)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())],
                                             ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = stored(features(docs, id_col, text_col), "quality-features")
    scored = score(rows, train(rows, chosen_labels(labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept.
    Rows are scored where they are: nothing is joined back."""
    chosen = stored(chosen_labels(labels), "quality-chosen")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    model = train(stored(features(own), "quality-features"), chosen)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], dtype=np.float32)))

    return docs.filter(score_of(F.col(text_col).cast("string")) >= threshold)


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
