"""The closed loop as one plan: train a grid on a window, pick and promote the
best run, score readings as a checkpointed stream, monitor, retrain on a
later window after drift, promote again and swap the stream's model.

State lives in tables below one folder: ``run_log`` and ``confusion`` (append
only), ``models/<run_id>``, the streamed ``predictions`` and its checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.operators import registry, scoring, training
from scorewatch.operators.prep import training_set
from scorewatch.sources import sinks, tables
from scorewatch.streaming import scoring as streaming

RETRAIN_DAYS = 7


@dataclass
class LoopPaths:
    root: str

    @property
    def run_log(self) -> str:
        return f"{self.root}/run_log"

    @property
    def claims(self) -> str:
        return f"{self.root}/claims"

    @property
    def confusion(self) -> str:
        return f"{self.root}/confusion"

    @property
    def models(self) -> str:
        return f"{self.root}/models"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/predictions_checkpoint"


def read_log(spark: SparkSession, paths: LoopPaths) -> DataFrame:
    from scorewatch.session import path_exists
    if path_exists(spark, paths.run_log):
        return spark.read.schema(registry.RUN_LOG_SCHEMA).parquet(paths.run_log)
    return spark.createDataFrame([], registry.RUN_LOG_SCHEMA)


def train_round(spark: SparkSession, paths: LoopPaths, readings: DataFrame, labels: DataFrame,
                start: str, end: str, at: str, families=("RandomForest", "DecisionTree"),
                parallelism: int = 3, experiment: str = registry.EXPERIMENT,
                grids: dict | None = None) -> str | None:
    """Fit the grids of ``families`` on one window, log runs and confusion
    counts at time ``at``, return the best run of the window (searched in the
    run log; None if there is none, as in a window without labelled rows). The training frame
    is prepared once."""
    key = f"{start} - {end}"
    read = partial(read_log, spark, paths)
    data = training.prepare(training_set(readings, labels, start, end))
    try:
        if not data.train.head(1):                                   # no label of the window has landed
            return None
        for fam in families:
            log = read()
            res = training.fit_grid(spark, data, fam, paths.models, window=key, finished=log,
                                    grid=(grids or {}).get(fam), parallelism=parallelism,
                                    experiment=experiment)
            if res.confusion is None:                                # nothing was left to fit
                continue
            with registry.claimed(spark, paths.claims, read) as (seq, _):
                rows = res.log.withColumns({"logged_at": F.lit(at).cast("timestamp_ntz"),
                                            "seq": F.lit(seq).cast("long")})
                sinks.write_batch(rows.coalesce(1), paths.run_log)   # one file: seen whole or not at all
            registry.log_confusion(res.confusion, paths.confusion)
    finally:
        data.release()
    log = read_log(spark, paths)
    found = registry.search_runs(log, params={"model_data_date": key}, experiment=experiment)
    metric = (registry.latest_values(log.filter((F.col("kind") == "metric") &
                                                (F.col("key") == "accuracy")))
              .select("run_id", F.col("value").cast("double").alias("accuracy")))
    best = registry.best_run(metric.join(found, "run_id"), "accuracy").first()
    return best["run_id"] if best else None


def retrain_window(drift: DataFrame, days: int = RETRAIN_DAYS) -> DataFrame:
    """The window to retrain on (start_day, end_day; empty without drift): the first
    ``days`` days of the latest stretch of consecutive drift days.

    ``drift`` has one row per drifting day (``monitor.drift_days``), so the window
    function runs over calendar days only.
    """
    number = F.row_number().over(Window.orderBy("window_day"))
    stretch = drift.select("window_day", F.date_sub("window_day", number).alias("_stretch"))
    spans = stretch.groupBy("_stretch").agg(F.min("window_day").alias("start_day"),
                                            F.max("window_day").alias("_last"))
    return spans.orderBy(F.desc("_last")).limit(1).select(
        "start_day", F.least("_last", F.date_add("start_day", days - 1)).alias("end_day"))


def drift_window(spark: SparkSession, paths: LoopPaths, labels: DataFrame, at: str,
                 experiment: str = registry.EXPERIMENT) -> DataFrame:
    """The window that drift asks to retrain on at time ``at`` (D2, M13; empty without any): the
    KPI of what the run in production has itself predicted, with the labels landed by then."""
    from scorewatch.operators.monitor import daily_kpi, drift_days
    run = registry.production_run(read_log(spark, paths), experiment).select("run_id").first()
    own = tables.predictions(spark, paths.predictions).filter(F.col("model_version") == (run[0] if run else None))
    landed = labels.filter(F.col("qualitycheck_time") <= F.lit(at).cast("timestamp_ntz"))
    return retrain_window(drift_days(daily_kpi(landed, own, ordered=False)))


def promote(spark: SparkSession, paths: LoopPaths, run_id: str, user: str, at: str,
            experiment: str = registry.EXPERIMENT) -> None:
    """Promote ``run_id`` in its experiment under a claimed append number: of two promotions at a
    time the second follows the first and ends its production."""
    with registry.claimed(spark, paths.claims, partial(read_log, spark, paths)) as (seq, log):
        rows = registry.promote(spark, log, run_id, user, at, experiment, seq)
        sinks.write_batch(rows.coalesce(1), paths.run_log)           # one file: seen whole or not at all


def confusion_of(spark: SparkSession, paths: LoopPaths, run_id: str) -> DataFrame:
    """The stored confusion matrix of a run, pivoted."""
    from scorewatch.operators.monitor import confusion_matrix
    return confusion_matrix(registry.read_confusion(spark, paths.confusion, run_id))


def model_of(spark: SparkSession, paths: LoopPaths, run_id: str):
    """The saved pipeline of a run, found through its ``spark_model`` tag."""
    tag = (registry.run_details(read_log(spark, paths), run_id)
           .filter(F.col("key") == "spark_model").select("value").first())
    return scoring.load_model(tag[0] if tag else f"{paths.models}/{run_id}")


def what_if_run(spark: SparkSession, paths: LoopPaths, readings: DataFrame, labels: DataFrame,
                run_id: str) -> DataFrame:
    """Daily KPI had ``run_id`` scored all of ``readings`` (C4)."""
    from scorewatch.operators.monitor import daily_kpi
    return daily_kpi(labels, scoring.score(model_of(spark, paths, run_id), readings, run_id))


def production_model(spark: SparkSession, paths: LoopPaths,
                     experiment: str = registry.EXPERIMENT):
    cur = registry.production_run(read_log(spark, paths), experiment) \
        .orderBy(F.col("seq").desc()).first()
    if cur is None:
        return None, None
    rid = cur["run_id"]
    return rid, model_of(spark, paths, rid)


def score_stream(spark: SparkSession, paths: LoopPaths, stream: DataFrame, query=None, **kw):
    """(Re)start the scoring stream with the current production model (C2, C3); a
    running ``query`` is stopped first. ``kw``: the sink's trigger options."""
    rid, model = production_model(spark, paths)
    if model is None:
        raise RuntimeError("no run is in production")
    return streaming.swap_model(query, stream, lambda r: scoring.score(model, r, rid),
                                paths.predictions, paths.checkpoint, **kw)
