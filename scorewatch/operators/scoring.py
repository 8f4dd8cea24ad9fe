"""Batch scoring with a saved pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Observation

from scorewatch.operators.training import scoring_counts
from scorewatch.sources.tables import FEATURES

PREDICTION_COLUMNS = ("pid", "process_time", "predicted_quality", "model_version")


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline saved by a grid run."""
    return PipelineModel.load(path)


def score(model: PipelineModel, readings: DataFrame, version: str) -> DataFrame:
    """Predictions in the written shape: pid, process_time, label text, version.

    Works on batch and streaming frames alike; the label-index stage is
    skipped when the readings carry no label column (T12), and rows with a
    missing feature are dropped by the assembler (T11).
    """
    out = model.transform(readings)
    return out.select("pid", "process_time", F.col("predicted_quality").cast("string"),
                      F.lit(version).alias("model_version"))


def score_counted(model: PipelineModel, readings: DataFrame, version: str,
                  features=FEATURES) -> tuple[DataFrame, Observation]:
    """``score`` of batch readings, and an observation of the rows read and of those dropped for a
    missing feature (T11). The counts are taken while the result is computed: after its first
    action, ``observation.get`` is {"rows": ..., "skipped": ...}."""
    seen = Observation("scoring")
    return score(model, readings.observe(seen, *scoring_counts(features)), version), seen
