"""Monitoring semantics on hand-written frames."""

import pyspark.sql.functions as F
import pytest

from scorewatch.operators import monitor
from tests.helpers import ts

PRED = "pid long, process_time timestamp_ntz, predicted_quality string, model_version string"
LAB = "pid long, qualitycheck_time timestamp_ntz, quality int"


def _pred(spark, rows):
    return spark.createDataFrame(rows, PRED)


def _lab(spark, rows):
    return spark.createDataFrame(rows, LAB)


def _naive_counts(labels, preds):
    j = preds.join(labels, "pid")
    return {(r["predicted_quality"], r["quality"]): r["count"]
            for r in j.groupBy("predicted_quality", "quality").count().collect()}


def test_flags_nulls_and_text_labels(spark):
    t = ts("2024-01-01 10:00:00")
    preds = _pred(spark, [(1, t, "1", "a"), (2, t, "x", "a"), (3, t, None, "a"), (4, t, "0", "a"),
                          (9, t, "1", "a")])  # pid 9 has no label yet (T3)
    labs = _lab(spark, [(1, t, 1), (2, t, 1), (3, t, 0), (4, t, None)])
    kpi = {r["accurate_prediction"]: r for r in monitor.daily_kpi(labs, preds).collect()}
    # T1: 'x' is not a number -> wrong, no error; T2: nulls -> wrong
    assert kpi["Accurate"]["count"] == 1 and kpi["Inaccurate"]["count"] == 3
    assert kpi["Accurate"]["total"] == 4
    assert kpi["Accurate"]["ratio"] == 25.0


def test_sparse_kpi_has_no_zero_rows(spark):
    t = ts("2024-01-02 00:00:00")
    preds = _pred(spark, [(1, t, "1", "a"), (2, t, "0", "a")])
    labs = _lab(spark, [(1, t, 1), (2, t, 0)])
    rows = monitor.daily_kpi(labs, preds).collect()
    assert [(r["accurate_prediction"], r["count"]) for r in rows] == [("Accurate", 2)]   # T4
    drift = monitor.drift_days(monitor.daily_kpi(labs, preds)).collect()
    assert drift == []


def test_day_without_accurate_rows_is_drift(spark):
    t = ts("2024-01-03 05:00:00")
    kpi = monitor.daily_kpi(_lab(spark, [(1, t, 1)]), _pred(spark, [(1, t, "0", "a")]))
    d = monitor.drift_days(kpi).collect()
    assert len(d) == 1 and d[0]["accurate_ratio"] == 0.0


def test_duplicate_keys_count_like_the_plain_join(spark):
    t = ts("2024-01-01 01:00:00")
    # T5: 2 predictions x 2 labels of one pid -> 4 pairs; a hot pid with many rows
    preds = _pred(spark, [(1, t, "1", "a"), (1, t, "1", "a")] +
                  [(7, t, "1" if i % 3 else "0", "a") for i in range(300)])
    labs = _lab(spark, [(1, t, 1), (1, t, 0)] + [(7, t, i % 2) for i in range(200)])
    pc = {(r["predicted_quality"], r["quality"]): r["count"]
          for r in monitor.pair_counts(labs, preds).collect()}
    assert pc == _naive_counts(labs, preds)
    kpi = monitor.daily_kpi(labs, preds).collect()
    assert sum(r["count"] for r in kpi) == 4 + 300 * 200


def test_versions_pooled_or_split(spark):
    t = ts("2024-01-05 12:00:00")
    preds = _pred(spark, [(1, t, "1", "m1"), (1, t, "0", "m2")])
    labs = _lab(spark, [(1, t, 1)])
    pooled = monitor.daily_kpi(labs, preds).collect()
    assert {r["accurate_prediction"]: r["ratio"] for r in pooled} == {"Accurate": 50.0,
                                                                      "Inaccurate": 50.0}
    split = monitor.daily_kpi(labs, preds, by_version=True).collect()
    assert {(r["model_version"], r["accurate_prediction"]) for r in split} == {
        ("m1", "Accurate"), ("m2", "Inaccurate")}


def test_confusion_matrix_fills_missing_cells(spark):
    counts = spark.createDataFrame([("1", 1, 5), ("0", 1, 2)], "predicted_quality string, "
                                   "quality int, count long")
    m = {r["predicted_quality"]: (r["quality_0"], r["quality_1"])
         for r in monitor.confusion_matrix(counts, classes=(0, 1)).collect()}
    assert m == {"0": (0, 2), "1": (0, 5)}


def test_stitch_switches_on_the_day(spark):
    kpi = spark.createDataFrame(
        [(ts("2024-01-15 00:00:00").date(), "Accurate", 1, 1, 100.0),
         (ts("2024-01-16 00:00:00").date(), "Accurate", 1, 1, 100.0)],
        "window_day date, accurate_prediction string, count long, total long, ratio double")
    out = monitor.stitch(kpi, kpi, "2024-01-16").collect()
    assert [(str(r["window_day"]), r["model_version"]) for r in out] == [
        ("2024-01-15", "m1"), ("2024-01-16", "m2")]


def test_kpi_plan_has_no_broadcast_of_growing_sides(spark):
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    kpi = monitor.daily_kpi(fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL))
    plan = kpi._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_in_production_attribution(spark):
    t = ts
    preds = _pred(spark, [(1, t("2024-01-01 00:00:00"), "1", "m"), (2, t("2024-01-02 00:00:00"), "1", "m"),
                          (3, t("2024-01-03 00:00:00"), "1", "m"), (4, t("2024-01-05 00:00:00"), "1", "m"),
                          (3, t("2024-01-03 00:00:00"), "0", "m")])
    labs = _lab(spark, [(1, t("2024-01-03 00:00:00"), 1), (2, t("2024-01-04 00:00:00"), 0),
                        (3, t("2024-01-05 00:00:00"), 1), (3, t("2024-01-05 00:00:00"), 1),
                        (4, t("2024-01-07 00:00:00"), 1)])
    promos = spark.createDataFrame(
        [("a", t("2024-01-02 00:00:00"), 10), ("b", t("2024-01-04 00:00:00"), 11)],
        "run_id string, ts timestamp_ntz, seq long")
    # pid 3: 2 predictions x 2 labels = 4 pairs, 2 of them right
    for key in ("long", "string"):          # the type of pid plays no part
        p, q = (f.withColumn("pid", F.concat(F.lit("" if key == "long" else "p"), F.col("pid").cast("string")).cast(key))
                for f in (preds, labs))
        got = {r["run_id"]: (r["readings"], r["accurate"])
               for r in monitor.in_production(q, p, promos).collect()}
        assert got == {"a": (5, 2), "b": (1, 1)}
    assert monitor.in_production(labs, preds, promos.limit(0)).collect() == []


def test_compare_flags_rows(spark):
    t = ts("2024-01-01 00:00:00")
    c = monitor.compare(_lab(spark, [(1, t, 1)]), _pred(spark, [(1, t, "1", "a")]))
    assert c.select(F.col("accurate_prediction")).first()[0] == 1


def test_any_set_of_classes(spark):
    t = ts("2024-01-01 10:00:00")
    preds = _pred(spark, [(i, t, str(i % 3), "a") for i in range(9)])
    labs = _lab(spark, [(i, t, i % 3) for i in range(9)])
    assert [(r["accurate_prediction"], r["count"]) for r in monitor.daily_kpi(labs, preds).collect()] == [("Accurate", 9)]
    assert monitor.accuracy(labs, preds).first()["accuracy"] == 1.0
    m = monitor.confusion_matrix(monitor.joined_confusion(labs, preds))
    assert [tuple(r) for r in m.collect()] == [("0", 3, 0, 0), ("1", 0, 3, 0), ("2", 0, 0, 3)]
    text = labs.withColumn("quality", F.concat(F.lit("grade "), F.col("quality")))
    said = preds.withColumn("predicted_quality", F.concat(F.lit("grade "), F.col("predicted_quality")))
    assert monitor.accuracy(text, said).first()["accuracy"] == 1.0
    with pytest.raises(ValueError, match="classes"):
        monitor.confusion_matrix(monitor.joined_confusion(labs, preds), classes=(0, 1))
    nulls = monitor.confusion_matrix(monitor.joined_confusion(labs.withColumn(
        "quality", F.when(F.col("quality") > 0, F.col("quality"))), preds))
    assert nulls.columns == ["predicted_quality", "quality_1", "quality_2", "quality_null"]


def test_join_is_split_by_aqe_not_by_a_key_list(spark):
    """Both sides of the pid join are plain exchanges, and nothing runs while planning."""
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = monitor.labelled(fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL))
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin"):]
    assert join.count("Exchange hashpartitioning(pid") >= 2 and "TakeOrdered" not in plan and "Limit" not in plan


def test_kpi_after_a_day_from_table_or_predictions(spark):
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    labs, preds = fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL)
    day = "2024-01-20"
    assert monitor.kpi_after(monitor.daily_kpi(labs, preds), day).collect() \
        == monitor.daily_kpi_after(labs, preds, day).collect()


def test_day_bounds_reach_the_scan(spark):
    from scorewatch.plans import catalog
    from tests.conftest import SF_SMALL
    for key in ("kpi_after", "kpi_stitched"):
        plan = catalog.QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan


def test_incremental_kpi_equals_full(spark):
    from scorewatch.plans import catalog
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    got = catalog.kpi_incremental(spark, SF_SMALL).orderBy("window_day", "accurate_prediction")
    want = monitor.daily_kpi(fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL, "m1"))
    assert got.collect() == want.collect()


def test_hot_pid_on_both_sides_is_counted_not_materialised(spark):
    """A third of all rows on one pid, both sides: 20,000 x 20,000 = 4e8 pairs.
    The plain join would emit them all; the KPI must count them exactly and fast."""
    import time
    n = 60000
    pid = F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id")).cast("long")
    t = F.lit("2024-01-02 03:00:00").cast("timestamp_ntz")
    preds = spark.range(n).select(pid.alias("pid"), t.alias("process_time"),
                                  F.lit("1").alias("predicted_quality"),
                                  F.lit("m").alias("model_version"))
    labs = spark.range(n).select(pid.alias("pid"), t.alias("qualitycheck_time"),
                                 (F.col("id") % 2).cast("int").alias("quality"))
    t0 = time.time()
    rows = {r["accurate_prediction"]: r["count"] for r in monitor.daily_kpi(labs, preds).collect()}
    assert time.time() - t0 < 60
    hot = n // 3                                   # ids 0, 3, 6, ... -> pid -7
    hot_right = hot * sum(1 for i in range(0, n, 3) if i % 2 == 1)
    cold = [i for i in range(n) if i % 3 != 0]
    right = hot_right + sum(1 for i in cold if i % 2 == 1)
    total = hot * hot + len(cold)
    assert rows["Accurate"] == right and rows["Accurate"] + rows["Inaccurate"] == total


def test_stitch_models_equals_stitched_kpis(spark):
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    labs = fx.labels(spark, SF_SMALL)
    m1, m2 = fx.predictions(spark, SF_SMALL, "m1"), fx.predictions(spark, SF_SMALL, "m2")
    cols = ["window_day", "model_version", "accurate_prediction", "count", "total", "ratio"]
    a = monitor.stitch(monitor.daily_kpi(labs, m1), monitor.daily_kpi(labs, m2), "2024-01-16")
    b = monitor.stitch_models(labs, m1, m2, "2024-01-16")
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_refresh_is_idempotent(spark):
    """A replayed label batch rewrites the same day partitions with the same rows."""
    from scorewatch.session import fresh_dir
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    labs, preds = fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL, "m1")
    path = fresh_dir(spark, "t-kpi")
    batch = labs.filter("qualitycheck_time > '2024-01-20'")
    monitor.refresh_kpi(labs, preds, labs, path)
    first = sorted(monitor.read_kpi(spark, path).collect())
    assert monitor.refresh_kpi(labs, preds, batch, path) > 0
    assert monitor.refresh_kpi(labs, preds, batch, path) > 0
    assert sorted(monitor.read_kpi(spark, path).collect()) == first


def test_refresh_by_version_empty_first_batch_and_missing_table(spark):
    from scorewatch.session import fresh_dir
    t = ts("2024-01-02 10:00:00")
    preds = _pred(spark, [(1, t, "1", "a"), (1, t, "0", "b"), (2, ts("2024-01-05 00:00:00"), "1", "a")])
    labs = _lab(spark, [(1, ts("2024-01-04 00:00:00"), 1), (2, ts("2024-01-07 00:00:00"), 1)])
    path = fresh_dir(spark, "t-kpi")
    assert monitor.refresh_kpi(labs, preds, labs.limit(0), path, by_version=True) == 0
    assert monitor.read_kpi(spark, path).collect() == []
    assert monitor.refresh_kpi(labs, preds, labs.limit(0), path) == 0
    assert monitor.refresh_kpi(labs, preds, labs, path, by_version=True) == 2
    got = monitor.read_kpi(spark, path, by_version=True).orderBy("window_day", "model_version").collect()
    assert [(r.model_version, r.accurate_prediction, r.total) for r in got] == [
        ("a", "Accurate", 1), ("b", "Inaccurate", 1), ("a", "Accurate", 1)]


def test_too_many_classes_for_a_pivot_raise(spark, monkeypatch):
    counts = spark.range(12).selectExpr("'1' AS predicted_quality", "id AS quality", "1L AS count")
    assert len(monitor.confusion_matrix(counts).columns) == 13
    monkeypatch.setattr(monitor, "MAX_CLASSES", 11)
    with pytest.raises(ValueError, match="more than 11"):
        monitor.confusion_matrix(counts)
