"""Exact deduplication by a tree merge of sorted digest runs (native).

Every input partition is one *run*: its rows, reduced to (digest, smallest
row, count) and sorted by digest. The runs are exchanged once, by digest range, so
that all rounds share the same ranges, and each range is sorted by digest and by
place in the merge tree. A round then merges ``fan_in`` neighbouring runs each: a
sorted aggregation by (digest, parent run), for which range and order already
fit, so that no round exchanges or sorts again and all of them stream through one
stage. An entry keeps the smallest identifier and the group size; entries merge
only when SHA-256, byte length and XXH64 of the normalised text all agree. The last
round leaves one run. A digest has at most one entry per run, however many rows
hold it. Groups of two or more return to the runs that hold them, and a row learns its
group through its own run: a group holding a third of all rows is spread over
as many join keys as there are partitions.

Defined cases: a null text counts as empty; a null id sorts after every other
id; of equal texts with equal smallest ids (repeated rows) exactly one row is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import SPACE, stored, table

KEY = ["sha", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: its run, its place, its digest."""
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").alias("norm"))
    return norm.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def merged(entries: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """The ``runs`` runs of ``entries(run, KEY, first, n)`` merged into one, in rounds of
    ``fan_in`` neighbours. ``up_k`` is an entry's run after round k; with the widest first,
    the rows sorted for one round are sorted for the next."""
    widths = [fan_in]
    while widths[-1] < runs:
        widths.append(widths[-1] * fan_in)
    tree = [f"up_{k}" for k in reversed(range(len(widths)))]
    level = entries.select(
        *KEY, "first", "n",
        *[F.floor(F.col("run") / w).cast("long").alias(f"up_{k}") for k, w in enumerate(widths)])
    level = level.repartitionByRange("sha")
    while tree:
        level = level.groupBy(*KEY, *tree).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        tree.pop()
    return level.select(*KEY, "first", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(digest_rows(docs, id_col, text_col), "digest-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = stored(rows.groupBy("run", *KEY).agg(F.min(first).alias("first"),
                                                 F.count(F.lit(1)).alias("n"))
                   .sortWithinPartitions("run", *KEY), "digest-runs")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    repeated = merged(level, runs, fan_in).filter("n > 1")
    groups = level.select("run", *KEY).join(repeated, KEY).select("run", *KEY, "first", "n")
    return (rows.join(stored(groups, "digest-groups"), ["run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
