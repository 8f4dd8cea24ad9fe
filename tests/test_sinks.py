"""Day-partitioned tables prune on day filters; slices append whole."""

import datetime as dt

import pyspark.sql.functions as F

from scorewatch.session import fresh_dir
from scorewatch.sources import fixtures as fx
from scorewatch.sources import sinks, tables
from tests.conftest import SF_SMALL


def test_day_partitions_prune(spark):
    path = fresh_dir(spark, "t-days")
    preds = fx.predictions(spark, SF_SMALL, "m1")
    sinks.write_by_day(preds, path, mode="overwrite")
    back = tables.predictions(spark, path)
    assert back.count() == preds.count()
    one = back.filter(F.col("process_day") == F.lit(dt.date(2024, 1, 5)))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(process_day" in plan
    assert one.count() == preds.filter(F.to_date("process_time") == "2024-01-05").count()
    # appending a later day leaves the others untouched
    sinks.write_by_day(preds.filter(F.to_date("process_time") == "2024-01-05"), path)
    assert tables.predictions(spark, path).count() == preds.count() + one.count()


def test_hot_day_and_instant_are_split(spark):
    path, key = fresh_dir(spark, "t-hot"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    hot = F.expr("CASE WHEN id % 3 = 0 THEN TIMESTAMP_NTZ'2024-01-05 10:00:00' "
                 "ELSE TIMESTAMP_NTZ'2024-01-06 00:00:00' + make_dt_interval(CAST(id % 20 AS INT)) END")
    rows = spark.range(0, 200_000, 1, 32).select(F.col("id").alias("pid"), hot.alias("process_time"))
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        sinks.write_by_day(rows, path, mode="overwrite")
    finally:
        spark.conf.set(key, before)
    back = spark.read.parquet(path)
    assert back.count() == 200_000
    files = back.filter("process_day = '2024-01-05'").select(F.col("_metadata.file_path")).distinct().count()
    assert files > 8
    path = fresh_dir(spark, "t-small")
    sinks.write_by_day(rows, path, mode="overwrite")
    files = spark.read.parquet(path).select("process_day", F.col("_metadata.file_path")).distinct()
    assert files.count() == files.select("process_day").distinct().count() == 21
