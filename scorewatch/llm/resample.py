"""Target-distribution importance resampling over hashed word features.

Features are runs of ``GRAM`` consecutive words; a feature's bucket is its CRC-32 modulo
``BUCKETS``. Bucket counts over all documents (raw) and all target texts give every bucket
a gain, the log ratio of its smoothed shares in thousandths; a document's weight is the sum
of the gains of its features, one array lookup per feature. Gumbel noise from a hash of
the id turns the top scores into a sample without replacement, drawn in proportion to the
exponentiated weights.

The draw. The texts are cut into buckets once and stored; scores are stored too. The
cutoff is found by numeric bisection, without a sort of the rows: a job counts the eligible
rows at or above ``CUTS`` thresholds at once and leaves the interval that holds the
wanted count, first on the score, then among the rows that tie with the cutoff on the id,
then, for repeated rows, on the row number. All counts are exact. Only the
drawn rows are range-partitioned, and each partition's size places its ranks.

Defined cases: a null text has no words; a document without features has weight 0; a null
id is hashed as the empty text and sorts last among ties; rows that are repeats of each
other share a score and are drawn by row number; without target texts or with an empty table
the smoothed shares still hold; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import UPPER, crc32_sql, in_order, python_tasks, stored, table

GRAM = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20              # documents with fewer are not drawn
PERCENT = 10                # of the eligible documents
CUTS = 31                   # thresholds counted by one job
LAST = 2**63 - 1            # stands for a null id

# Bytes that part words: all of ASCII but digits and letters; A-Z become a-z.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))
PIECE = 1 << 22             # bytes of a text turned into words at a time, about


def buckets_of(text: str | None, gram: int = GRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LETTER)
    words, found, held = 0, [], []
    seen: dict[bytes, int] = {}                           # features repeat: one CRC-32 each
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        own = raw[at:end].split()
        words += len(own)
        own = held + own
        runs = own if gram == 1 else [b" ".join(own[i:i + gram]) for i in range(len(own) - gram + 1)]
        held = own[len(own) - gram + 1:] if gram > 1 else []
        for r in runs:
            if r not in seen:
                seen[r] = zlib.crc32(r) % buckets
        found.append(np.fromiter((seen[r] for r in runs), np.int32, len(runs)))
        at = end
    return words, np.concatenate(found) if found else np.zeros(0, np.int32)


def hashed(docs: DataFrame, id_col: str | None, text_col: str, gram: int, buckets: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, codes): codes are the 32-bit buckets of the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [buckets_of(t, gram, buckets) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n for n, _ in got], pa.int64()),
                 pa.array([len(c) for _, c in got], pa.int64()),
                 pa.array([c.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes() for _, c in got], pa.binary())],
                ["row", "doc_id", "n_words", "n_features", "codes"])

    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, codes binary")


def _codes(column: pa.Array, buckets: int) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2" if buckets <= 1 << 16 else "<u4") for x in column.to_pylist()]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all ``rows``; at most ``buckets`` sums reach the driver."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for c in _codes(b.column(0), buckets):
                total += np.bincount(c, minlength=buckets) if len(c) > buckets else 0
                if len(c) <= buckets:
                    np.add.at(total, c, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    sums = rows.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, from the counts in raw and target texts."""
    s, t, k = raw.astype(float), target.astype(float), len(raw)
    ratio = (t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with the sum of the gains of their features in place of the codes."""
    def run(batches):
        for b in batches:
            total = [int(gain[c].sum()) for c in _codes(b.column(4), len(gain))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(total, pa.int64())],
                                             ["row", "doc_id", "n_words", "n_features", "weight"])

    return rows.select("row", "doc_id", "n_words", "n_features", "codes").mapInArrow(
        run, "row long, doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


# ---- the draw -----------------------------------------------------------------------------

def bisect(rows: DataFrame, key: str, wanted: int) -> tuple[int, int]:
    """The largest value v of the long ``key`` that at least ``wanted`` rows reach
    (key >= v), and how many rows lie above it. ``rows`` has at least ``wanted`` rows."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0                                            # rows with key > high
    while low < high:
        width = high - low
        cuts = sorted({low + 1 + (width - 1) * i // CUTS for i in range(CUTS)} | {high})
        got = rows.filter(F.col(key) >= cuts[0]).agg(*[F.count_if(F.col(key) >= c) for c in cuts]).first()
        for c, n in zip(reversed(cuts), reversed(got)):
            if n >= wanted:
                low = c                                  # the answer is in [c, high]
                break
            high, above = c - 1, n
    return low, above


def drawn(rows: DataFrame, wanted: int) -> Column:
    """Which of ``rows(row, key_id, score)`` are the ``wanted`` best: a condition."""
    if wanted <= 0:
        return F.lit(False)
    chosen, ties = F.lit(False), F.lit(True)
    for key in ("score", "key_id", "row"):               # ids and rows count from the smallest
        flip = key != "score"
        own = rows.filter(ties).select((F.bitwise_not(key) if flip else F.col(key)).alias("k"))
        value, above = bisect(own, "k", wanted)
        at = ~value if flip else value
        better = F.col(key) < at if flip else F.col(key) > at
        chosen, ties = chosen | (ties & better), ties & (F.col(key) == at)
        wanted -= above
    return chosen | ties


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, gram: int = GRAM,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn)."""
    python_tasks(docs.sparkSession)
    rows = stored(hashed(docs, id_col, text_col, gram, buckets), "resample-codes")
    goal = stored(hashed(target, None, target_text, gram, buckets), "resample-target")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(goal, buckets))
    scored = stored(weighted(rows, gain).withColumn("score", F.col("weight") + noise(seed=seed))
                    .withColumn("key_id", F.coalesce("doc_id", F.lit(LAST))), "resample-scores")
    fit = scored.filter(F.col("n_words") >= min_words)
    wanted = percent * fit.count() // 100
    chosen = (F.col("n_words") >= min_words) & drawn(fit, wanted)
    order = [F.col("all"), F.desc("score"), F.col("key_id"), F.col("row")]
    best = in_order(scored.filter(chosen).withColumn("all", F.lit(0)), order, ["all"], "resample")
    out = ["doc_id", "n_features", "weight", "score"]
    return best.select(*out, (F.col("pos") + 1).alias("rank")).unionAll(
        scored.filter(~chosen).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
codes AS (SELECT word, {crc32_sql('word')} % {BUCKETS} AS bucket
          FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN codes USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT k.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + {BUCKETS})
                 / ((coalesce(s.s, 0) + 1)::DOUBLE * (total.t + {BUCKETS}))))::BIGINT AS gain
         FROM (SELECT DISTINCT bucket FROM codes) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weight AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN codes USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))
    ::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight USING (row)),
best AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, row) AS rank FROM scored WHERE n_features >= {MIN_WORDS}
         QUALIFY rank <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {MIN_WORDS}))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN best USING (row)
"""
