"""Batch sinks (K1-K3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_batch(df: DataFrame, path: str, mode: str = "append",
                max_records_per_file: int | None = None,
                partition_by: Sequence[str] = ()) -> None:
    """Overwrite or append a parquet table; optional cap of rows per file and
    partition columns (partitioning by day lets later day filters prune)."""
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def with_process_day(df: DataFrame, col: str = "process_time") -> DataFrame:
    """Add the ``process_day`` partition column (date of ``col``)."""
    from pyspark.sql import functions as F
    return df.withColumn("process_day", F.to_date(col))


def write_by_day(df: DataFrame, path: str, mode: str = "append", col: str = "process_time") -> None:
    """Write partitioned by process day, so day filters prune whole folders;
    appends only touch the days present (``partitionOverwriteMode=dynamic`` for
    overwrites). Rows are first rebalanced by day: a small day is one file, not one
    per task, and AQE splits a large day, or one hot instant of it, over as many
    tasks as its bytes need (``advisoryPartitionSizeInBytes``)."""
    days = with_process_day(df, col)
    (days.hint("rebalance", "process_day").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("process_day").parquet(path))
