"""Streams joined with watermarks, the production model resolved per batch, observed counts."""

import pyspark.sql.functions as F

from scorewatch.operators import monitor, registry
from scorewatch.plans import workflow
from scorewatch.session import fresh_dir
from scorewatch.sources import sinks, tables
from scorewatch.streaming import joined
from scorewatch.streaming import scoring as streaming
from tests.helpers import ts

PRED = "pid long, process_time timestamp_ntz, predicted_quality string, model_version string"
LAB = "pid long, qualitycheck_time timestamp_ntz, quality int"


def test_state_is_dropped_after_the_lag_and_late_labels_are_left_to_the_batch_path(spark):
    pdir, ldir, out, ckpt = (fresh_dir(spark, n) for n in ("p", "l", "out", "ckpt"))
    sinks.write_batch(spark.createDataFrame([], PRED), pdir)
    sinks.write_batch(spark.createDataFrame([], LAB), ldir)
    pairs = joined.labelled_stream(streaming.stream_predictions(spark, pdir), streaming.stream_labels(spark, ldir),
                                   lag="3 days", delay="1 day")
    q = streaming.write_stream(pairs, out, ckpt, available_now=False)
    held = []
    try:
        for day in range(1, 21, 3):
            preds = [(100 * day + i, ts(f"2024-01-{day:02d} 10:00:00"), "1", "a") for i in range(50)]
            labels = [(100 * day + i, ts(f"2024-01-{day + 2:02d} 00:00:00"), i % 2) for i in range(40)]
            if day == 16:
                labels.append((100, ts("2024-01-17 00:00:00"), 1))          # two weeks after its prediction
            sinks.write_batch(spark.createDataFrame(preds, PRED), pdir)
            sinks.write_batch(spark.createDataFrame(labels, LAB), ldir)
            q.processAllAvailable()
            held.append(joined.state_rows(q))
    finally:
        q.stop()
    assert max(held) < 350 and held[-1] <= held[3]                           # of 630 rows by then, a lag's worth
    got = spark.read.parquet(out)
    assert got.count() == 280 and got.filter("pid = 100").count() == 1       # not the late one
    labels, preds = tables.labels(spark, ldir), tables.predictions(spark, pdir)
    on_time = labels.filter("pid <> 100 OR qualitycheck_time < '2024-01-10'")
    assert sorted(joined.kpi_of_pairs(got).collect()) == sorted(monitor.daily_kpi(on_time, preds).collect())


def test_a_replayed_batch_is_scored_once_by_the_run_in_production(spark, tmp_path):
    src, out, ckpt = (fresh_dir(spark, n) for n in ("src", "out", "ckpt"))
    paths = workflow.LoopPaths(fresh_dir(spark, "loop"))
    schema = "pid long, process_time timestamp_ntz, temp double, pressure double, duration double"

    def resolve():
        run = registry.production_run(workflow.read_log(spark, paths)).first()["run_id"]
        return run, lambda r: r.select("pid", "process_time", F.lit("1").alias("predicted_quality"),
                                       F.lit(run).alias("model_version"))

    def arrive(lo):
        rows = [(i, ts("2024-01-01 00:00:00"), 1.0, 1.0, None if i % 2 else 1.0) for i in range(lo, lo + 10)]
        sinks.write_batch(spark.createDataFrame(rows, schema).coalesce(1), src)

    def run():
        q = streaming.score_production(streaming.observed(streaming.stream_readings(spark, src)), resolve, out, ckpt)
        q.awaitTermination()
        return q

    for lo, name in ((0, "a"), (10, "b")):
        workflow.promote(spark, paths, name, "t", "2024-01-02 00:00:00")
        arrive(lo)
        q = run()
        assert streaming.observed_counts(q) == {"rows": 10, "skipped": 5}
    jvm = spark.sparkContext._jvm
    commit = jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/1")              # the last batch was written, not committed
    fs = commit.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.delete(commit, False)
    run()
    got = tables.predictions(spark, out).groupBy("model_version").agg(F.count("pid").alias("n"),
                                                                      F.count_distinct("pid").alias("pids")).collect()
    assert sorted(map(tuple, got)) == [("a", 10, 10), ("b", 10, 10)]
