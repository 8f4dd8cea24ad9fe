"""Monitoring kept by signed deltas: each batch adds and subtracts counts.

A batch is either predictions or label changes. It is stored, joined with what earlier
batches hold of the other side, and leaves one small table of signed counts by (day,
version, predicted, quality). KPI, accuracy, confusion and class shares are sums over
these tables and never read predictions or labels again.

Labels change by ``add`` (one more label), ``correct`` (the labels a pid has from earlier
batches go, this one comes) and ``remove`` (they go). Corrections leave rows with negative counts, so
the sums stay equal to what a full recomputation would give.

Batches have increasing ids (as ``foreachBatch`` gives them). The counts folder of a batch
is its entry in the ledger: it is written last, and a batch that has one is not applied again. A
batch that failed before is rewritten whole, so a replay never counts twice.

Both sides lie in folders of neighbouring pids: a batch reads the blocks of its own pids.
Defined cases: null pids match nothing; null qualities are a class; a pid may have several
labels and several predictions, each pair counts; several corrections of a pid in one batch
all come; an empty batch counts nothing and is in the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.columns import correct_flag, window_day
from scorewatch.operators import monitor
from scorewatch.operators.locator import PID_SPAN, blocks_of, in_blocks, pid_block
from scorewatch.session import path_exists, store

KEYS = ["window_day", "model_version", "predicted_quality", "quality"]
COUNTS = "kind string, window_day date, model_version string, predicted_quality string, quality string, count long"
PREDICTIONS = "pid long, window_day date, model_version string, predicted_quality string, batch long, pid_block long"
LABELS = "pid long, quality string, n long, batch long, pid_block long"
PAIR, SCORED = "pair", "scored"


@dataclass(frozen=True)
class Deltas:
    root: str
    span: int = PID_SPAN

    def committed(self, spark: SparkSession) -> list[int]:
        """Ids in the ledger: batches whose counts are complete."""
        jvm = spark.sparkContext._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.root}/counts/batch=*/_SUCCESS")
        fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(glob) or [])

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def _put(self, rows: DataFrame, table: str, batch: int) -> None:
        (rows.withColumn("pid_block", pid_block(self.span)).hint("rebalance", "pid_block")
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("pid_block")
         .parquet(self._folder(table, batch)))

    def _get(self, spark: SparkSession, table: str, schema: str, batches: list[int], pids: DataFrame) -> DataFrame:
        """Rows of ``batches`` in the blocks of ``pids``."""
        folders = [f for b in batches if path_exists(spark, f := self._folder(table, b))]
        if not folders:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*folders)
        return in_blocks(rows, blocks_of(pids, self.span))

    def _labels(self, spark: SparkSession, before: int, pids: DataFrame) -> DataFrame:
        """(pid, quality, n): the labels of ``pids`` after all batches below ``before``."""
        done = [b for b in self.committed(spark) if b < before]
        rows = self._get(spark, "labels", LABELS, done, pids).join(pids.select("pid").distinct(), "pid", "left_semi")
        return rows.groupBy("pid", "quality").agg(F.sum("n").alias("n")).filter("n <> 0")

    def _commit(self, pairs: DataFrame, scored: DataFrame | None, batch: int) -> None:
        """Signed counts of ``pairs(..., n)``, and of new predictions, as the batch's ledger entry."""
        rows = pairs.groupBy(*KEYS).agg(F.sum("n").cast("long").alias("count")).select(
            F.lit(PAIR).alias("kind"), *KEYS, "count")
        if scored is not None:
            new = scored.groupBy(*KEYS[:3]).agg(F.count(F.lit(1)).alias("count"))
            rows = rows.unionByName(new.select(F.lit(SCORED).alias("kind"), *KEYS[:3],
                                               F.lit(None).cast("string").alias("quality"), "count"))
        rows.filter("count <> 0").coalesce(1).write.mode("overwrite").parquet(self._folder("counts", batch))

    def append_predictions(self, batch: int, predictions: DataFrame) -> bool:
        """Apply a batch of predictions; False if the ledger has it."""
        spark = predictions.sparkSession
        done = self.committed(spark)
        if batch in done:
            return False
        own = predictions.select("pid", window_day("process_time").alias("window_day"), "model_version",
                                 F.col("predicted_quality").cast("string").alias("predicted_quality"))
        self._put(own, "predictions", batch)
        own = spark.read.schema(PREDICTIONS).option("basePath", f"{self.root}/predictions").parquet(
            self._folder("predictions", batch))
        self._commit(own.join(self._labels(spark, batch, own), "pid"), own, batch)
        return True

    def change_labels(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of ``changes(pid, quality, op)``; False if the ledger has it."""
        spark = changes.sparkSession
        done = self.committed(spark)
        if batch in done:
            return False
        changes = store(changes.select("pid", F.col("quality").cast("string").alias("quality"), "op"), "label-changes")
        gone = self._labels(spark, batch, changes.filter("op IN ('correct', 'remove')")).withColumn("n", -F.col("n"))
        come = changes.filter("op IN ('add', 'correct')").select("pid", "quality", F.lit(1).cast("long").alias("n"))
        delta = gone.select("pid", "quality", "n").unionByName(come)
        self._put(delta.groupBy("pid", "quality").agg(F.sum("n").alias("n")).filter("n <> 0"), "labels", batch)
        delta = spark.read.schema(LABELS).option("basePath", f"{self.root}/labels").parquet(
            self._folder("labels", batch)).select("pid", "quality", "n")
        preds = self._get(spark, "predictions", PREDICTIONS, [b for b in done if b < batch], delta)
        self._commit(preds.join(delta, "pid"), None, batch)
        return True

    # ---- reads --------------------------------------------------------------------------

    def _counts(self, spark: SparkSession, kind: str) -> DataFrame:
        folders = [self._folder("counts", b) for b in self.committed(spark)]
        rows = spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)
        return rows.filter(F.col("kind") == kind).drop("kind")

    def totals(self, spark: SparkSession) -> DataFrame:
        """(window_day, model_version, predicted_quality, quality, count): labelled pairs now."""
        return (self._counts(spark, PAIR).groupBy(*KEYS).agg(F.sum("count").cast("long").alias("count"))
                .filter("count <> 0"))

    def _flags(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        right = correct_flag("predicted_quality", "quality") * F.col("count")
        return self.totals(spark).groupBy(*keys).agg(F.sum(right).cast("long").alias("_right"),
                                                     F.sum("count").cast("long").alias("total"))

    def kpi(self, spark: SparkSession, by_version: bool = False) -> DataFrame:
        """``monitor.daily_kpi`` of everything applied so far."""
        keys = ["window_day"] + ["model_version"] * by_version
        return monitor.kpi_rows(self._flags(spark, keys), keys).orderBy(*keys, "accurate_prediction")

    def accuracy(self, spark: SparkSession) -> DataFrame:
        return self._flags(spark, ["model_version"]).select(
            "model_version", (F.col("_right") / F.col("total")).alias("accuracy"), F.col("total").alias("n"))

    def confusion(self, spark: SparkSession, by: list[str] | None = None) -> DataFrame:
        """Counts by (``by``..., predicted, actual); labels are text."""
        return self.totals(spark).groupBy(*(by or []), "predicted_quality", "quality").agg(
            F.sum("count").cast("long").alias("count"))

    def class_share(self, spark: SparkSession) -> DataFrame:
        """``monitor.daily_class_share`` of all predictions, labelled or not."""
        counts = (self._counts(spark, SCORED).groupBy("window_day", "predicted_quality")
                  .agg(F.sum("count").cast("long").alias("count")))
        return monitor.with_share(counts, ["window_day"], "predicted_quality")
