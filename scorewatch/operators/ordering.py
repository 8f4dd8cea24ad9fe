"""Operators over one global order (next/previous row, as-of carry-forward)
without moving the whole table into one partition.

A window without ``partitionBy`` sends every row to a single task. Here the rows
are range-partitioned on the order columns by Spark; a row's partition number is
its block, and the blocked table is written to the shared folder, so that it is
the same for every consumer and after a lost executor. Each block is solved on
its own; the only cross-block information is one row per block (its first or
last row), fixed up with a small window and joined back.

With ``by`` every operator works within a key: rows are range-partitioned on key and order, so
a block edge may cut a key, a large key spans many blocks and small keys share one.

The number of blocks follows the data (``ROWS_PER_BLOCK``, at least the number of
shuffle partitions); the rows are counted first, so store a frame that is dear to
compute before it comes here. The order columns should end in a unique tie-breaker, which
also splits a hot timestamp over several blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.session import store

ROWS_PER_BLOCK = 2_000_000


def _blocks(df: DataFrame, order: Sequence[str], n: int | None, by: Sequence[str] = ()) -> DataFrame:
    if n is None:
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-df.count() // ROWS_PER_BLOCK))
    return store(df.repartitionByRange(n, *by, *order)
                 .withColumn("_block", F.spark_partition_id()), "order-blocks")


def _stitched(inner: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beside the one row of their block (and key) in ``edges``."""
    on = [F.col("i._block") == F.col("e._block"), *[F.col(f"i.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]]
    return inner.alias("i").join(edges.alias("e"), on, "left").select("i.*", "e._edge")


def lead_in_order(df: DataFrame, order: Sequence[str], value: str, out: str,
                  blocks: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``lead(value) OVER (PARTITION BY by... ORDER BY order...)`` over the whole frame."""
    b = _blocks(df, order, blocks, by)
    w = Window.partitionBy("_block", *by).orderBy(*order)
    inner = (b.withColumn(out, F.lead(value).over(w))
             .withColumn("_last", F.lead(F.lit(1)).over(w).isNull()))
    firsts = b.groupBy("_block", *by).agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_f"))
    after = Window.partitionBy(*by).orderBy("_block")
    edges = firsts.withColumn("_edge", F.lead(F.col("_f")["_v"]).over(after)).select("_block", *by, "_edge")
    return (_stitched(inner, edges, by).withColumn(out, F.when(F.col("_last"), F.col("_edge")).otherwise(F.col(out)))
            .drop("_block", "_last", "_edge"))


def lag_in_order(df: DataFrame, order: Sequence[str], value: str, out: str,
                 blocks: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``lag(value) OVER (PARTITION BY by... ORDER BY order...)`` over the whole frame."""
    b = _blocks(df, order, blocks, by)
    w = Window.partitionBy("_block", *by).orderBy(*order)
    inner = (b.withColumn(out, F.lag(value).over(w))
             .withColumn("_first", F.lag(F.lit(1)).over(w).isNull()))
    lasts = b.groupBy("_block", *by).agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_l"))
    before = Window.partitionBy(*by).orderBy("_block")
    edges = lasts.withColumn("_edge", F.lag(F.col("_l")["_v"]).over(before)).select("_block", *by, "_edge")
    return (_stitched(inner, edges, by).withColumn(out, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(out)))
            .drop("_block", "_first", "_edge"))


def carry_forward(df: DataFrame, order: Sequence[str], value: str, out: str,
                  blocks: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Last non-null ``value`` at or before each row in the order within ``by``
    (as-of lookup when the value rows and the probe rows are unioned)."""
    b = _blocks(df, order, blocks, by)
    w = (Window.partitionBy("_block", *by).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumn(out, F.last(value, ignorenulls=True).over(w))
    lasts = (b.groupBy("_block", *by).agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
        .alias("_l")))
    before = (Window.partitionBy(*by).orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    edges = (lasts.withColumn("_edge", F.last(F.col("_l")["_v"], ignorenulls=True).over(before))
             .select("_block", *by, "_edge"))
    return (_stitched(inner, edges, by).withColumn(out, F.coalesce(F.col(out), F.col("_edge")))
            .drop("_block", "_edge"))
