"""Streams: rerun on a checkpoint adds nothing; a model swap keeps old rows."""

import pyspark.sql.functions as F

from scorewatch.plans import catalog
from scorewatch.session import fresh_dir
from scorewatch.sources import fixtures as fx
from scorewatch.sources import tables
from scorewatch.streaming import scoring as streaming
from tests.conftest import SF_SMALL


def test_rerun_on_same_checkpoint_adds_nothing(spark):
    out, ckpt = fresh_dir(spark, "t-out"), fresh_dir(spark, "t-ckpt")
    stream = streaming.stream_event_readings(spark, SF_SMALL)
    for _ in range(2):
        q = streaming.stream_score(stream, lambda r: fx.rule_predictions(r, "m1"), out, ckpt)
        q.awaitTermination()
    assert tables.predictions(spark, out).count() == fx.readings(spark, SF_SMALL).count()


def test_swap_keeps_old_versions(spark):
    got = catalog.stream_swap(spark, SF_SMALL)
    n_before = fx.readings(spark, SF_SMALL).filter(F.col("process_time") < "2024-01-16").count()
    by = {r["model_version"]: r["count"] for r in got.groupBy("model_version").count().collect()}
    assert by["m1"] == n_before
    assert sum(by.values()) == fx.readings(spark, SF_SMALL).count()


def test_swap_of_a_live_query_mid_stream(spark):
    """A query with files still to read is stopped and swapped: every reading is
    scored once, by one of the two models."""
    from scorewatch.sources import sinks
    src, out, ckpt = (fresh_dir(spark, f"t-{n}") for n in ("src", "out", "ckpt"))
    ev = fx.events(spark, SF_SMALL)
    sinks.write_batch(ev.repartition(12), src, mode="overwrite")
    stream = fx.readings_from_events(streaming.stream_table(spark, src, ev.schema, max_files_per_trigger=1))
    q = streaming.stream_score(stream, lambda r: fx.rule_predictions(r, "m1"), out, ckpt, available_now=False)
    while not q.recentProgress and q.isActive:
        q.awaitTermination(0.2)
    live = q.isActive
    q2 = streaming.swap_model(q, stream, lambda r: fx.rule_predictions(r, "m2"), out, ckpt, available_now=False)
    q2.processAllAvailable()
    q2.stop()
    assert live and not q.isActive
    got = tables.predictions(spark, out)
    assert got.count() == got.select("pid").distinct().count() == ev.count()
    by = {r["model_version"]: r["count"] for r in got.groupBy("model_version").count().collect()}
    assert by["m1"] > 0 and sum(by.values()) == ev.count()


def test_refresh_on_arrival_without_available_now(spark):
    from scorewatch.operators import monitor
    from scorewatch.sources import sinks
    from scorewatch.streaming import monitor as kpi_stream
    src, kpi, ckpt = (fresh_dir(spark, f"t-{n}") for n in ("labels", "kpi", "ckpt"))
    labels, preds = fx.labels(spark, SF_SMALL), fx.predictions(spark, SF_SMALL, "m1")
    sinks.write_batch(labels, src, mode="overwrite")
    q = kpi_stream.refresh_on_arrival(streaming.stream_labels(spark, src), lambda: tables.labels(spark, src),
                                      lambda: preds, kpi, ckpt, available_now=False)
    q.processAllAvailable()
    q.stop()
    assert sorted(monitor.read_kpi(spark, kpi).collect()) == sorted(monitor.daily_kpi(labels, preds).collect())
