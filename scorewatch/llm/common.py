"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import scorewatch
from scorewatch.session import fresh_dir
from scorewatch.session import store as stored  # noqa: F401  used by the operators

# Fixed value: the white space class of the contracts (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows per Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(rows: int, of: int, *key: str) -> Column:
    """True for about ``rows`` of ``of`` rows, chosen by a hash of their unique ``key``."""
    share = 10**15 if of <= rows else 10**15 * rows // of
    return F.pmod(F.xxhash64(*key), F.lit(10**15)) < share


_SHIPPED: set[str] = set()


def python_tasks(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Get a session ready for operators that run Python in tasks: bound the rows of
    an Arrow batch (texts can be megabytes each), and send the library's code to the
    executors once, as a zip in the shared folder."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    sc = spark.sparkContext
    root = Path(scorewatch.__file__).parent
    if sc.applicationId in _SHIPPED or not root.is_dir():       # not a folder: shipped by the user
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{fresh_dir(spark, 'code')}/scorewatch.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(body.getvalue()))
    out.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters untouched."""
    return F.translate(c, UPPER, UPPER.lower())


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text's UTF-8 bytes."""
    raw = f"hex(encode({text}))"
    digit = "(instr('0123456789ABCDEF', substr({0}, {1}, 1)) - 1)"
    byte = f"16 * {digit.format(raw, '2 * i + 1')} + {digit.format(raw, '2 * i + 2')}"
    step = "xor(v >> 1, 3988292384 * (v & 1))"          # fixed value: the reversed polynomial
    return (f"xor(list_reduce([({byte})::BIGINT FOR i IN range(octet_length(encode({text})))], "
            f"lambda c, b: list_reduce(range(8), lambda v, k: {step}, xor(c, b)), 4294967295::BIGINT), 4294967295)")


def in_order(df: DataFrame, order: list[Column], group: list[str], name: str) -> DataFrame:
    """``df`` stored with ``pos``: its place from 0 among the rows of its ``group`` columns,
    in ``order`` (which starts with the group). Rows are range-partitioned, so a large
    group is spread over blocks; only the blocks' counts meet in a window."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, -(-df.count() // 1_000_000))
    blocks = stored(df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), f"{name}-blocks")
    sizes = blocks.groupBy(*group, "block").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("block", *group).orderBy(*order)) - 1
    same = [F.col(f"rows.{g}").eqNullSafe(F.col(f"starts.{g}")) for g in group]
    return stored(blocks.withColumn("place", place).alias("rows")
                  .join(starts.alias("starts"), [F.col("rows.block") == F.col("starts.block"), *same])
                  .select("rows.*", (F.col("start") + F.col("place")).cast("long").alias("pos"))
                  .drop("block", "place"), f"{name}-places")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
