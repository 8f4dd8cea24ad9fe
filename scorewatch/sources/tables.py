"""Typed batch scans of the three tables of the monitoring loop.

Tables are parquet folders. Readings and labels are read with a fixed schema
(no inference, no footer merge); predictions keep their stored schema, whose
``predicted_quality`` is text and which carries ``model_version``.
Filters and projections applied by callers reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READINGS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType(), True),
    T.StructField("process_time", T.TimestampNTZType(), True),
    T.StructField("temp", T.DoubleType(), True),
    T.StructField("pressure", T.DoubleType(), True),
    T.StructField("duration", T.DoubleType(), True),
])

LABELS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType(), True),
    T.StructField("qualitycheck_time", T.TimestampNTZType(), True),
    T.StructField("quality", T.IntegerType(), True),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType(), True),
    T.StructField("process_time", T.TimestampNTZType(), True),
    T.StructField("predicted_quality", T.StringType(), True),
    T.StructField("model_version", T.StringType(), True),
])

FEATURES = ("temp", "pressure", "duration")


def readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READINGS_SCHEMA).parquet(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS_SCHEMA).parquet(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
