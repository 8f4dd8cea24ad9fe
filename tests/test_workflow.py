"""The closed loop on the smallest data: train, promote, stream, retrain, swap."""

from concurrent.futures import ThreadPoolExecutor

import pyspark.sql.functions as F
import pytest

from scorewatch.operators import registry
from scorewatch.plans import workflow
from scorewatch.session import fresh_dir
from scorewatch.sources import fixtures as fx
from scorewatch.sources import sinks, tables
from scorewatch.streaming import scoring as streaming
from tests.conftest import SF_SMALL

W1 = ("2024-01-01 00:00:00", "2024-01-10 23:59:00")
W2 = ("2024-01-14 00:00:00", "2024-01-20 23:59:00")


def test_loop(spark):
    paths = workflow.LoopPaths(fresh_dir(spark, "t-loop"))
    readings, labels = fx.noisy(spark, SF_SMALL), fx.labels(spark, SF_SMALL)
    rid1 = workflow.train_round(spark, paths, readings, labels, *W1, at="2024-01-11 17:00:00",
                                families=("DecisionTree",))
    log = workflow.read_log(spark, paths)
    assert registry.run_exists(log, {"model": "DecisionTree", "maxDepth": 3,
                                     "model_data_date": " - ".join(W1)})
    assert not registry.run_exists(log, {"model": "DecisionTree", "maxDepth": 99})
    workflow.promote(spark, paths, rid1, "tester", "2024-01-11 18:00:00")
    assert workflow.production_model(spark, paths)[0] == rid1

    # first arrival scored by the first production model
    ev = fx.events(spark, SF_SMALL)
    src = fresh_dir(spark, "t-src")
    sinks.write_batch(ev.filter(F.col("ts") < "2024-01-16"), src, mode="overwrite")
    stream = fx.perturb(fx.readings_from_events(streaming.stream_table(spark, src, ev.schema)))
    q = workflow.score_stream(spark, paths, stream)
    q.awaitTermination()

    # retrain after drift; the rerun of round 1 would fit nothing new
    rid2 = workflow.train_round(spark, paths, readings, labels, *W2, at="2024-01-21 00:30:00",
                                families=("DecisionTree",))
    workflow.promote(spark, paths, rid2, "tester", "2024-01-21 01:00:00")
    log = workflow.read_log(spark, paths)
    state = {r["run_id"]: r["value"] for r in registry.latest_values(
        log.filter("kind = 'tag' and key = 'state'")).collect()}
    assert state[rid2] == "production"
    if rid1 != rid2:
        assert state[rid1] == "ex_production"

    sinks.write_batch(ev.filter(F.col("ts") >= "2024-01-16"), src, mode="append")
    q = workflow.score_stream(spark, paths, stream, query=q)
    q.awaitTermination()
    out = tables.predictions(spark, paths.predictions)
    assert out.count() == ev.count()
    n_before = ev.filter(F.col("ts") < "2024-01-16").count()
    if rid1 != rid2:   # rows of the first arrival keep the first model's version (C3)
        assert out.filter(F.col("model_version") == rid1).count() == n_before
        assert out.filter(F.col("model_version") == rid2).count() == ev.count() - n_before

    # what-if: the first model over all history
    kpi = workflow.what_if_run(spark, paths, readings, labels, rid1)
    assert kpi.count() > 0
    assert set(kpi.columns) == {"window_day", "accurate_prediction", "count", "total", "ratio"}

    # the stored confusion counts of a run sum to its test rows
    m = workflow.confusion_of(spark, paths, rid1)
    assert m.count() > 0 and {c for c in m.columns if c != "predicted_quality"} <= {"quality_0", "quality_1"}


def test_round_without_runs_returns_none(spark, monkeypatch):
    paths = workflow.LoopPaths(fresh_dir(spark, "t-loop"))
    readings, labels = fx.noisy(spark, SF_SMALL), fx.labels(spark, SF_SMALL)
    assert workflow.train_round(spark, paths, readings, labels, *W1, at="2024-01-11 17:00:00", families=()) is None


def test_retrain_window_is_the_latest_stretch(spark):
    days = [f"2024-01-{d:02d}" for d in (3, 4, 10, 11, 12, 13, 14, 15, 16, 17, 18)]
    drift = spark.createDataFrame([(d, 1.0) for d in days], "d string, accurate_ratio double").selectExpr(
        "to_date(d) AS window_day", "accurate_ratio")
    assert [str(x) for x in workflow.retrain_window(drift).first()] == ["2024-01-10", "2024-01-16"]
    assert [str(x) for x in workflow.retrain_window(drift.filter("window_day < '2024-01-05'")).first()] == [
        "2024-01-03", "2024-01-04"]
    assert workflow.retrain_window(drift.limit(0)).collect() == []


def test_training_frame_is_written_once_per_round(spark, monkeypatch):
    from scorewatch.operators import training
    seen = []
    real = training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df: seen.append(1) or real(df))
    paths = workflow.LoopPaths(fresh_dir(spark, "t-loop"))
    grids = {"RandomForest": [{"numTrees": 3, "maxDepth": 3}], "DecisionTree": [{"maxDepth": 3}]}
    rid = workflow.train_round(spark, paths, fx.noisy(spark, SF_SMALL), fx.labels(spark, SF_SMALL), *W1,
                               at="2024-01-11 17:00:00", grids=grids)
    assert rid is not None and len(seen) == 1
    log = workflow.read_log(spark, paths)
    assert registry.run_params(log, ["model"]).count() == 2 and registry.next_seq(log) == 2


def test_two_promotions_at_a_time_leave_one_production_run(spark):
    paths = workflow.LoopPaths(fresh_dir(spark, "t-loop"))
    workflow.promote(spark, paths, "old", "t", "2024-01-01 00:00:00")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda r: workflow.promote(spark, paths, r, "t", "2024-01-02 00:00:00"), ["a", "b", "c", "d"]))
    log = workflow.read_log(spark, paths)
    assert registry.production_run(log).count() == 1
    assert sorted(r[0] for r in log.select("seq").distinct().collect()) == [0, 1, 2, 3, 4]


def test_lost_and_failed_claims(spark):
    folder = fresh_dir(spark, "t-claims")
    empty = spark.createDataFrame([], registry.RUN_LOG_SCHEMA)
    with pytest.raises(OSError):                                 # nothing appended: the number is free again
        with registry.claimed(spark, folder, lambda: empty):
            raise OSError
    with registry.claimed(spark, folder, lambda: empty) as (seq, _):
        assert seq == 0
        with pytest.raises(RuntimeError, match="number 0 .*t-claims"):
            with registry.claimed(spark, folder, lambda: empty, patience=0.5):
                pass


def test_the_streamed_model_decides_the_window(spark):
    from scorewatch.plans import catalog
    m1, m2 = (catalog._streamed_window(spark, SF_SMALL, v).collect() for v in ("m1", "m2"))
    assert m1 and m1 != m2
