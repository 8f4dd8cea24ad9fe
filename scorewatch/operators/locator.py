"""Where a pid's predictions lie: a table of (pid block, pid, day).

Labels name a pid, while predictions are stored by day. The locator is kept when
predictions are appended: one narrow row per pid and day, in folders of ``span``
neighbouring pids. New labels read only the folders of their own pids, so finding the days
they touch costs as much as the labels, not as much as the predictions; labels that
land late, or have no time, are found in the same way as those on time.

A lookup collects the numbers of the blocks that the pids fall in: at most as many as the
table has folders, which the driver lists anyway. Pids without a block (null) match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.columns import window_day
from scorewatch.session import path_exists
from scorewatch.sources import sinks

PID_SPAN = 1_000_000            # neighbouring pids that share a folder
SCHEMA = "pid long, window_day date, pid_block long"


def pid_block(span: int, pid: str = "pid") -> Column:
    return F.floor(F.col(pid) / span).cast("long")


def blocks_of(pids: DataFrame, span: int) -> list[int]:
    """Numbers of the blocks that ``pids(pid)`` fall in."""
    found = pids.select(pid_block(span).alias("b")).filter("b IS NOT NULL").distinct()
    return sorted(r[0] for r in found.collect())


def write_by_pid(df: DataFrame, path: str, span: int = PID_SPAN, mode: str = "append") -> None:
    """Write partitioned by pid block, so that reads for some pids prune folders; AQE splits
    a block with many rows over tasks."""
    rows = df.withColumn("pid_block", pid_block(span))
    (rows.hint("rebalance", "pid_block").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("pid_block").parquet(path))


def in_blocks(df: DataFrame, blocks: list[int]) -> DataFrame:
    """Rows of a table stored by pid block that lie in ``blocks``: a filter on folders."""
    return df.filter(F.col("pid_block").isin(blocks)) if blocks else df.limit(0)


@dataclass(frozen=True)
class Locator:
    path: str
    span: int = PID_SPAN

    def append(self, predictions: DataFrame) -> None:
        """Add the days of newly appended predictions. Repeats are harmless."""
        rows = predictions.select("pid", window_day("process_time").alias("window_day")).dropna().distinct()
        write_by_pid(rows, self.path, self.span)

    def entries(self, spark: SparkSession, pids: DataFrame) -> DataFrame:
        """(pid, window_day) rows in the blocks of ``pids``, other pids of the blocks included."""
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], SCHEMA)
        return in_blocks(spark.read.schema(SCHEMA).parquet(self.path), blocks_of(pids, self.span))

    def days(self, pids: DataFrame) -> DataFrame:
        """Days that hold a prediction of any of ``pids``."""
        rows = self.entries(pids.sparkSession, pids)
        return rows.join(pids.select("pid").distinct(), "pid", "left_semi").select("window_day").distinct()


def append_predictions(predictions: DataFrame, path: str, locator: Locator, mode: str = "append") -> None:
    """Append to the predictions by day and to the locator, the locator first: a failure in
    between leaves entries too many, never too few."""
    locator.append(predictions)
    sinks.write_by_day(predictions, path, mode=mode)
