"""Column profiles and row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.columns import hash_bucket


def describe_long(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """count / mean / stddev / min / max per column, typed, one row per column.

    One aggregation pass for all columns (partial aggregates combine
    map-side); the unpivot runs on the single result row.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)

    def r(x):
        return F.round(x, digits) if digits is not None else x

    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     r(F.col(f"{c}__mean")).alias("mean"), r(F.col(f"{c}__stddev")).alias("stddev"),
                     r(F.col(f"{c}__min")).alias("min"), r(F.col(f"{c}__max")).alias("max"))
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spark's ``describe``: one row per statistic, values as text (A5, as the
    reference displays it). ``describe_long`` is the typed form."""
    return df.describe(*cols)


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Deterministic sample: rows whose md5 bucket of ``key`` is below ``percent``."""
    return df.filter(hash_bucket(key, 100) < percent)


def sample_rows(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Bernoulli sample without replacement (F5, as the reference does)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
