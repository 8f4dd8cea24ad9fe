"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver's ``events`` table (readings, labels and rule
models are derived from it, see ``sources.fixtures``) over whole tables.
Queries that write (sinks, streams) use fresh folders below the shared folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.columns import Measure, epoch_to_ts, offset_key, window_key
from scorewatch.operators import deltas, locator, monitor, prep, profile, registry, scoring, training, tree_rows
from scorewatch.plans import workflow
from scorewatch.streaming import joined
from scorewatch.streaming import monitor as kpi_stream
from scorewatch.streaming import scoring as streaming
from scorewatch.session import fresh_dir, small_frame
from scorewatch.sources import fixtures as fx
from scorewatch.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

RULE_GRID = [{"lo": lo, "hi": hi} for lo in (0, 5, 20) for hi in (80, 120, 200)]
WIDER_GRID = [{"lo": lo, "hi": hi} for lo in (0, 5, 20, 30) for hi in (80, 120, 200, 250)]
KPI_AFTER_DAY = "2024-01-20"
DETAIL_RUN = "3"
DEMOTED_RUN = "4"
PROMOTED_AT = "2024-02-01 00:00:00"
DRIFT_SEEN_AT = "2024-01-18 00:30:00"
LABEL_LAG_DAYS = 3          # labels of the fixture land at most so long after a reading
STREAM_DELAY_DAYS = 10      # its files are that far from being in order
PID_SPAN = 2_000            # neighbouring pids per folder; the events tables have some 10,000 a scale step
# One cheap point per family, for the keys that check a fitted path row by row.
SMALL_GRIDS = {"RandomForest": [{"numTrees": 5, "maxDepth": 3}], "DecisionTree": [{"maxDepth": 3}],
               "GBT": [{"numTrees": 3, "learningRate": 0.3}]}


# --- shared pieces ---------------------------------------------------------------
def _labels(spark, sf_dir):
    return fx.labels(spark, sf_dir)


def _pred(spark, sf_dir, version):
    return fx.predictions(spark, sf_dir, version)


def _both_models(spark, sf_dir):
    return fx.rule_predictions_many(fx.noisy(spark, sf_dir), ("m1", "m2"))


def _kpi(spark, sf_dir, version="m1", ordered=True):
    return monitor.daily_kpi(_labels(spark, sf_dir), _pred(spark, sf_dir, version),
                             ordered=ordered)


def _train_frame(spark, sf_dir):
    return prep.training_set(fx.noisy(spark, sf_dir), _labels(spark, sf_dir), *fx.TRAIN_WINDOW)


def _grid_runs(spark, sf_dir, grid=RULE_GRID):
    return training.rule_grid_hits(_train_frame(spark, sf_dir), grid)


def _grid_log(spark, sf_dir):
    runs = _grid_runs(spark, sf_dir).withColumn(
        "run_id", F.concat_ws("-", F.lit("rule"), F.col("lo"), F.col("hi"))
    ).withColumn("model_data_date", window_key(*fx.TRAIN_WINDOW))
    return registry.log_runs(runs, params=["lo", "hi", "model_data_date"], metrics=["hits"],
                             tags={"state": registry.DEV},
                             logged_at=F.lit(None).cast("timestamp_ntz"))


def _tag_log(spark, sf_dir):
    """Tag log stand-in: run = user, key = event type, value = props text."""
    ev = fx.events(spark, sf_dir)
    return ev.select(F.col("user_id").cast("string").alias("run_id"), F.lit("tag").alias("kind"),
                     F.col("event_type").alias("key"), F.col("props").alias("value"),
                     F.col("ts").alias("logged_at"), F.col("event_id").alias("seq"))


def _promotions(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    return (ev.filter(F.col("event_type") == "signup")
            .select(F.col("user_id").cast("string").alias("run_id"), "ts",
                    F.col("event_id").alias("seq")))


# --- monitoring --------------------------------------------------------------------
def kpi_daily(spark, sf_dir):
    return _kpi(spark, sf_dir)


def kpi_from_tables(spark, sf_dir):
    """Write readings, labels and scored predictions as tables, then monitor
    from typed scans of them (K1, S1-S3, D1)."""
    base = fresh_dir(spark, "tables")
    sinks.write_batch(fx.readings(spark, sf_dir), f"{base}/readings", mode="overwrite")
    sinks.write_batch(_labels(spark, sf_dir), f"{base}/labels", mode="overwrite")
    r = tables.readings(spark, f"{base}/readings")
    sinks.write_batch(fx.rule_predictions(fx.perturb(r), "m1"), f"{base}/predictions",
                      mode="overwrite")
    return monitor.daily_kpi(tables.labels(spark, f"{base}/labels"),
                             tables.predictions(spark, f"{base}/predictions"))


def kpi_incremental(spark, sf_dir):
    """KPI table kept by incremental refreshes: labels inspected up to 01-20
    first, then the later labels; only touched days, found by the locator, are rewritten,
    from the label blocks of their pids. The table then equals the full KPI."""
    path, ptab, ltab = (fresh_dir(spark, n) for n in ("kpi", "predictions", "labels"))
    find = locator.Locator(fresh_dir(spark, "locator"), PID_SPAN)
    locator.append_predictions(_pred(spark, sf_dir, "m1"), ptab, find, mode="overwrite")
    preds = tables.predictions(spark, ptab)
    early, late = _early_and_late(_labels(spark, sf_dir))
    for part in (early, late):
        locator.write_by_pid(part, ltab, PID_SPAN)
        monitor.refresh_kpi(spark.read.parquet(ltab), preds, part, path, locator=find)
    return monitor.read_kpi(spark, path)


def _early_and_late(labels):
    cut = F.col("qualitycheck_time") <= F.lit("2024-01-20").cast("timestamp_ntz")
    return labels.filter(cut), labels.filter(~cut)


def kpi_on_arrival(spark, sf_dir):
    """KPI table kept current by a label stream (foreachBatch refresh of the
    touched days): labels inspected up to 01-20 arrive first, the rest later;
    the stream is restarted on its checkpoint in between."""
    src, ptab, kpi, ckpt = (fresh_dir(spark, n) for n in ("labels", "predictions", "kpi", "ckpt"))
    find = locator.Locator(fresh_dir(spark, "locator"), PID_SPAN)
    locator.append_predictions(_pred(spark, sf_dir, "m1"), ptab, find, mode="overwrite")
    for i, part in enumerate(_early_and_late(_labels(spark, sf_dir))):
        sinks.write_batch(part, src, mode="overwrite" if i == 0 else "append")
        stream = streaming.stream_labels(spark, src)
        _run_stream(kpi_stream.refresh_on_arrival(
            stream, lambda: tables.labels(spark, src), lambda: tables.predictions(spark, ptab),
            kpi, ckpt, locator=find))
    return monitor.read_kpi(spark, kpi)


def _by_deltas(spark, sf_dir):
    """Deltas after two batches of predictions and labels each, wrong labels among them, a batch of
    corrections and replays of two batches."""
    state = deltas.Deltas(fresh_dir(spark, "deltas"), PID_SPAN)
    preds = _pred(spark, sf_dir, "m1")
    cut = F.col("process_time") < F.lit(fx.SWITCH_DAY).cast("timestamp_ntz")
    early, late = _early_and_late(_labels(spark, sf_dir))
    wrong = F.col("pid") % 10 == 0
    bad = early.withColumn("quality", F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")))
    state.append_predictions(0, preds.filter(cut))
    state.change_labels(1, bad.withColumn("op", F.lit("add")))
    state.append_predictions(2, preds.filter(~cut))
    state.change_labels(3, late.withColumn("op", F.lit("add")))
    state.change_labels(4, early.filter(wrong).withColumn("op", F.lit("correct")))
    state.change_labels(4, early.filter(wrong).withColumn("op", F.lit("correct")))
    state.append_predictions(2, preds.filter(~cut))
    return state


def kpi_delta(spark, sf_dir):
    """The KPI as a sum of signed deltas, after a correction and replayed batches."""
    return _by_deltas(spark, sf_dir).kpi(spark)


def confusion_delta(spark, sf_dir):
    """Confusion counts as sums of signed deltas, after the labels of some pids were removed."""
    state = _by_deltas(spark, sf_dir)
    gone = _labels(spark, sf_dir).filter(F.col("pid") % 97 == 0)
    state.change_labels(5, gone.withColumn("op", F.lit("remove")))
    return state.confusion(spark, ["model_version"])


def class_share_delta(spark, sf_dir):
    """The daily class shares as sums of signed deltas (A4)."""
    return _by_deltas(spark, sf_dir).class_share(spark)


def kpi_streams(spark, sf_dir):
    """Predictions and labels joined as streams with watermarks; the KPI of what they gave. Both
    arrive in two parts, the query restarts on its checkpoint and its state in between."""
    pdir, ldir, out, ckpt = (fresh_dir(spark, n) for n in ("predictions", "labels", "pairs", "ckpt"))
    preds = _pred(spark, sf_dir, "m1")
    cut = F.col("process_time") < F.lit(fx.SWITCH_DAY).cast("timestamp_ntz")
    for p, q in zip((preds.filter(cut), preds.filter(~cut)), _early_and_late(_labels(spark, sf_dir))):
        sinks.write_batch(p, pdir)
        sinks.write_batch(q, ldir)
        pairs = joined.labelled_stream(streaming.stream_predictions(spark, pdir), streaming.stream_labels(spark, ldir),
                                       lag=f"{LABEL_LAG_DAYS} days", delay=f"{STREAM_DELAY_DAYS} days")
        _run_stream(streaming.write_stream(pairs, out, ckpt))
    return joined.kpi_of_pairs(spark.read.parquet(out))


def confusion_matrix(spark, sf_dir):
    counts = monitor.joined_confusion(_labels(spark, sf_dir), _pred(spark, sf_dir, "m1"))
    return monitor.confusion_matrix(counts)


def confusion_log(spark, sf_dir):
    return monitor.joined_confusion(_labels(spark, sf_dir), _both_models(spark, sf_dir),
                                    by=["model_version"])


def class_share(spark, sf_dir):
    return monitor.daily_class_share(_pred(spark, sf_dir, "m1"))


def drift_days(spark, sf_dir):
    return monitor.drift_days(_kpi(spark, sf_dir, ordered=False))


def kpi_stitched(spark, sf_dir):
    return monitor.stitch_models(_labels(spark, sf_dir), _pred(spark, sf_dir, "m1"),
                                 _pred(spark, sf_dir, "m2"), fx.SWITCH_DAY)


def kpi_after(spark, sf_dir):
    return monitor.daily_kpi_after(_labels(spark, sf_dir), _pred(spark, sf_dir, "m1"), KPI_AFTER_DAY)


def kpi_stitch(spark, sf_dir):
    """Two models' KPI tables, stitched at the switch day."""
    return monitor.stitch(_kpi(spark, sf_dir, "m1", ordered=False), _kpi(spark, sf_dir, "m2", ordered=False),
                          fx.SWITCH_DAY)


def what_if(spark, sf_dir):
    """Both models rescore all history (C4), KPI per version."""
    return monitor.what_if(_labels(spark, sf_dir),
                           {v: _pred(spark, sf_dir, v) for v in ("m1", "m2")})


def kpi_grades(spark, sf_dir):
    """The KPI over three quality grades."""
    return monitor.daily_kpi(fx.grades(spark, sf_dir), fx.grade_predictions(spark, sf_dir))


def confusion_grades(spark, sf_dir):
    return monitor.confusion_matrix(monitor.joined_confusion(
        fx.grades(spark, sf_dir), fx.grade_predictions(spark, sf_dir)))


def accuracy_grades(spark, sf_dir):
    return monitor.accuracy(fx.grades(spark, sf_dir), fx.grade_predictions(spark, sf_dir))


def run_confusion(spark, sf_dir):
    """Confusion counts of two runs stored, one run's found and pivoted."""
    path = fresh_dir(spark, "confusion")
    registry.log_confusion(confusion_log(spark, sf_dir).withColumnRenamed("model_version", "run_id"), path)
    return monitor.confusion_matrix(registry.read_confusion(spark, path, "m2"))


def accuracy_by_model(spark, sf_dir):
    return monitor.accuracy(_labels(spark, sf_dir), _both_models(spark, sf_dir))


def in_production(spark, sf_dir):
    return monitor.in_production(_labels(spark, sf_dir), _pred(spark, sf_dir, "m1"),
                                 _promotions(spark, sf_dir))


def _experiments(df, key="pid"):
    return df.withColumn("experiment", F.when(F.col(key) % 2 == 0, "even").otherwise("odd"))


def in_production_by_experiment(spark, sf_dir):
    """D5 with two interleaved experiments: runs replace each other within their own."""
    promotions = _experiments(_promotions(spark, sf_dir), "seq")
    return monitor.in_production(_labels(spark, sf_dir), _experiments(_pred(spark, sf_dir, "m1")), promotions,
                                 by=["experiment"])


# --- preparation ---------------------------------------------------------------------
def training_set(spark, sf_dir):
    return prep.training_set(fx.readings(spark, sf_dir), _labels(spark, sf_dir),
                             *fx.TRAIN_WINDOW)


def measured_readings(spark, sf_dir):
    """All three features scaled, shifted and shaken."""
    how = {"temp": Measure(1.5, -2.0, 1.0), "pressure": Measure(shift=3.0, noise=0.5), "duration": Measure(scale=0.5)}
    return prep.measured(fx.readings(spark, sf_dir), how, fx.noise_of())


def due_slice(spark, sf_dir):
    from scorewatch.functions.columns import inspection_due
    s = prep.time_slice(fx.readings(spark, sf_dir), "process_time", *fx.ARRIVAL_CUTS[:2])
    return s.select("pid", "process_time", inspection_due("process_time").alias("qualitycheck_time"))


def rule_label(spark, sf_dir):
    return _labels(spark, sf_dir)


def combined_readings(spark, sf_dir):
    r = fx.readings(spark, sf_dir)
    early = prep.time_slice(r, "process_time", hi=fx.SWITCH_DAY)
    late = prep.time_slice(r, "process_time", lo=fx.SWITCH_DAY)
    late = late.select("duration", "temp", "pid", "pressure", "process_time")
    return prep.combine(early, late)


def valid_features(spark, sf_dir):
    r = fx.readings(spark, sf_dir).withColumn(
        "duration", F.when(F.col("duration") == 50, F.lit(None)).otherwise(F.col("duration")))
    return prep.valid_features(r, tables.FEATURES).select("pid", *tables.FEATURES)


def epoch_readings(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    secs = F.col("event_id") * 450.0 + 1704067200 + F.round("value", 0)
    return ev.select(offset_key("event_id", 100000).alias("pid"),
                     epoch_to_ts(secs).alias("process_time"))


def _slices(spark, sf_dir):
    path = fresh_dir(spark, "slices")
    r = fx.readings(spark, sf_dir).withColumn(
        "batch", prep.slice_index("process_time", fx.ARRIVAL_CUTS))
    bounds = [None, *fx.ARRIVAL_CUTS, None]
    for i in range(4):
        part = prep.time_slice(r, "process_time", bounds[i], bounds[i + 1])
        sinks.write_batch(part, path, mode="overwrite" if i == 0 else "append",
                          max_records_per_file=50 if i == 3 else None)
    return spark.read.parquet(path)


def batch_write_slices(spark, sf_dir):
    """Overwrite with the first slice, append the next three, the last one at 50
    rows per file (K1-K3); read back and count rows per slice."""
    return _slices(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))


def slice_files(spark, sf_dir):
    """The files of the slice written at 50 rows per file (K3): rows, and files above the cap."""
    own = _slices(spark, sf_dir).filter("batch = 3").groupBy(F.input_file_name().alias("file")).count()
    return own.agg(F.sum("count").cast("long").alias("rows"), F.count_if(F.col("count") > 50).alias("files_above"))


# --- profiling, splits, features ---------------------------------------------------------
def describe_value(spark, sf_dir):
    return profile.describe_long(fx.readings(spark, sf_dir), tables.FEATURES)


def hash_split(spark, sf_dir):
    return training.split_counts(fx.readings(spark, sf_dir))


def hash_sample(spark, sf_dir):
    j = fx.readings(spark, sf_dir).join(_labels(spark, sf_dir).select("pid", "quality"), "pid")
    return profile.hash_sample(j, "pid", 99).select("temp", "pressure", "duration", "quality")


def random_sample(spark, sf_dir):
    """Bernoulli sample of 99 % of the feature rows (F5, the reference's form;
    seeded here). Rows-only check: the exact form is ``hash_sample``."""
    j = fx.readings(spark, sf_dir).join(_labels(spark, sf_dir).select("pid", "quality"), "pid")
    return profile.sample_rows(j.select(*tables.FEATURES, "quality"), 0.99, seed=27)


def random_split(spark, sf_dir):
    """80/20 ``randomSplit`` with seed 1234 of the training table (M1, the
    reference's form): rows per side. Rows-only; the exact form is ``hash_split``."""
    train, test = training.random_split(_train_frame(spark, sf_dir))
    return (train.select(F.lit("train").alias("split")).unionByName(
        test.select(F.lit("test").alias("split")))
        .groupBy("split").agg(F.count(F.lit(1)).alias("rows")))


def random_split_total(spark, sf_dir):
    """The two sides of ``randomSplit`` hold every row once (M1)."""
    train, test = training.random_split(_train_frame(spark, sf_dir).select("pid"))
    both = train.unionByName(test)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pid").alias("pids"))


def random_sample_outside(spark, sf_dir):
    """Sampled feature rows that are not in the base table: none."""
    r = fx.readings(spark, sf_dir).select(*tables.FEATURES)
    gone = profile.sample_rows(r, 0.99, seed=27).join(
        r.distinct(), list(tables.FEATURES), "left_anti")
    return gone.dropna().agg(F.count(F.lit(1)).alias("rows"))


def label_index(spark, sf_dir):
    return training.label_frequencies(_labels(spark, sf_dir), "quality") \
        .select("label", "count", "label_index")


def scaled_features(spark, sf_dir):
    s = training.scale(fx.readings(spark, sf_dir).select("pid", *tables.FEATURES))
    return s.select("pid", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled")
                             for c in tables.FEATURES])


# --- rule grids and the run log --------------------------------------------------------------
def grid_best(spark, sf_dir):
    return registry.best_run(_grid_runs(spark, sf_dir), "hits", ties=("lo", "hi"))


def best_run_per_family(spark, sf_dir):
    return registry.best_per_group(_grid_runs(spark, sf_dir), group="lo", metric="hits", tie="hi")


def pending_grid(spark, sf_dir):
    finished = registry.run_params(_grid_log(spark, sf_dir), ["lo", "hi"])
    grid = small_frame(spark, WIDER_GRID, "lo int, hi int")
    return registry.pending_grid(grid, finished, ["lo", "hi"])


def run_log(spark, sf_dir):
    return _grid_log(spark, sf_dir).select("run_id", "kind", "key", "value")


def latest_tag(spark, sf_dir):
    cur = registry.latest_values(_tag_log(spark, sf_dir), keys=("run_id", "key"),
                                 order=("logged_at", "seq"))
    return cur.select("run_id", "key", "value", "logged_at")


def run_details(spark, sf_dir):
    log = _tag_log(spark, sf_dir).filter(F.col("run_id") == DETAIL_RUN)
    cur = registry.latest_values(log, keys=("run_id", "kind", "key"), order=("logged_at", "seq"))
    return cur.select("run_id", "kind", "key", "value", "logged_at")


def run_search(spark, sf_dir):
    ev = fx.events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"), "event_type",
        fx.props_k().alias("k"), "ts")
    log = registry.log_runs(ev, params=["event_type", "k"], logged_at=F.col("ts"))
    return registry.search_runs(log, params={"event_type": "click", "k": "9"})


def production_intervals(spark, sf_dir):
    return registry.production_intervals(_promotions(spark, sf_dir))


def production_intervals_by_experiment(spark, sf_dir):
    """R9 with two interleaved experiments."""
    return registry.production_intervals(_experiments(_promotions(spark, sf_dir), "seq"))


def _state_log(spark, sf_dir):
    """State tags from events: two experiments (by user), hourly times (so many rows
    share one), ``seq`` the event number."""
    ev = fx.events(spark, sf_dir).filter(F.col("event_type").isin("signup", "error"))
    return ev.select(
        F.col("user_id").cast("string").alias("run_id"), F.lit("tag").alias("kind"), F.lit("state").alias("key"),
        F.when(F.col("event_type") == "signup", registry.PRODUCTION).otherwise(registry.EX_PRODUCTION).alias("value"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("logged_at"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("experiment"),
        F.col("event_id").cast("long").alias("seq"))


def production_run(spark, sf_dir):
    """Runs in production of one experiment."""
    return registry.production_run(_state_log(spark, sf_dir), "even")


def promote_cycle(spark, sf_dir):
    """Promote a run, then another at the same time (R7): the runs then in
    production, in both experiments."""
    log = _state_log(spark, sf_dir)
    for run in ("new-1", "new-2"):
        log = log.unionByName(registry.promote(spark, log, run, "scorewatch", PROMOTED_AT, "odd"))
    return registry.production_run(log).select("run_id", "logged_at", "seq")


def demote(spark, sf_dir):
    """End one run's production (R8): the runs then in production of its experiment."""
    log = _state_log(spark, sf_dir)
    log = log.unionByName(registry.demote(spark, log, DEMOTED_RUN, "scorewatch", PROMOTED_AT, "even"))
    return registry.production_run(log, "even").select("run_id", "seq")


def promotion_log(spark, sf_dir):
    return registry.promotion_log(_promotions(spark, sf_dir))


# --- streams ----------------------------------------------------------------------------
def _rule_scorer(version):
    return lambda r: fx.rule_predictions(fx.perturb(r), version)


def _run_stream(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def stream_score_rule(spark, sf_dir):
    """Stream the events file set, score with rule model m1, append with a
    checkpoint (S4, C2, K4); a rerun on the same checkpoint adds nothing."""
    out, ckpt = fresh_dir(spark, "pred"), fresh_dir(spark, "ckpt")
    stream = streaming.stream_event_readings(spark, sf_dir)
    _run_stream(streaming.stream_score(stream, _rule_scorer("m1"), out, ckpt))
    _run_stream(streaming.stream_score(stream, _rule_scorer("m1"), out, ckpt))
    return tables.predictions(spark, out)


def stream_readings(spark, sf_dir):
    """Readings table read as a typed stream (S4), appended (K4)."""
    src, out, ckpt = (fresh_dir(spark, n) for n in ("readings", "readings_out", "ckpt"))
    sinks.write_batch(fx.readings(spark, sf_dir), src, mode="overwrite")
    _run_stream(streaming.write_stream(streaming.stream_readings(spark, src), out, ckpt))
    return tables.readings(spark, out)


def stream_labels(spark, sf_dir):
    """Labels table written in slices, read as a stream (S5), appended (K4)."""
    src, out, ckpt = (fresh_dir(spark, n) for n in ("labels", "labels_out", "ckpt"))
    sinks.write_batch(_labels(spark, sf_dir), src, mode="overwrite", max_records_per_file=5000)
    s = streaming.stream_labels(spark, src, max_files_per_trigger=4)
    _run_stream(streaming.write_stream(s, out, ckpt))
    return tables.labels(spark, out)


def stream_predictions(spark, sf_dir):
    """A scoring stream's output read back as a stream (S6) into a second sink."""
    out1, ck1, out2, ck2 = (fresh_dir(spark, n) for n in ("pred", "ckpt", "pred2", "ckpt2"))
    stream = streaming.stream_event_readings(spark, sf_dir)
    _run_stream(streaming.stream_score(stream, _rule_scorer("m1"), out1, ck1))
    _run_stream(streaming.write_stream(streaming.stream_predictions(spark, out1), out2, ck2))
    return tables.predictions(spark, out2)


def _swap_scorer(threshold, version):
    return lambda r: r.select(
        "pid", "process_time",
        F.when(F.col("temp") > threshold, "1").otherwise("0").alias("predicted_quality"),
        F.lit(version).alias("model_version"))


def stream_swap(spark, sf_dir):
    """Model swap on a running stream (C3): the first arrival is scored by a live
    query with m1, which the swap stops; the stream restarts on the same checkpoint
    with m2 for the second arrival; rows already written keep m1."""
    src, out, ckpt = (fresh_dir(spark, n) for n in ("arrivals", "pred", "ckpt"))
    ev = fx.events(spark, sf_dir)
    sinks.write_batch(prep.time_slice(ev, "ts", hi=fx.SWITCH_DAY), src, mode="overwrite")
    stream = fx.readings_from_events(streaming.stream_table(spark, src, ev.schema))
    q = streaming.stream_score(stream, _swap_scorer(5, "m1"), out, ckpt, available_now=False)
    q.processAllAvailable()
    q = streaming.swap_model(q, stream, _swap_scorer(30, "m2"), out, ckpt, available_now=False)
    sinks.write_batch(prep.time_slice(ev, "ts", lo=fx.SWITCH_DAY), src, mode="append")
    q.processAllAvailable()
    q.stop()
    return tables.predictions(spark, out)


def stream_promote(spark, sf_dir):
    """A promotion between two micro-batches of one live query (C2, C3): m1 is in production for
    the first arrival, m2 is promoted, and the next batch is scored by m2 without a restart."""
    src, out, ckpt = (fresh_dir(spark, n) for n in ("arrivals", "pred", "ckpt"))
    paths = workflow.LoopPaths(fresh_dir(spark, "loop"))
    scorers = {"m1": _swap_scorer(5, "m1"), "m2": _swap_scorer(30, "m2")}

    def resolve():
        run = registry.production_run(workflow.read_log(spark, paths)).first()["run_id"]
        return run, scorers[run]

    ev = fx.events(spark, sf_dir)
    workflow.promote(spark, paths, "m1", "scorewatch", "2024-01-11 18:00:00")
    sinks.write_batch(prep.time_slice(ev, "ts", hi=fx.SWITCH_DAY), src, mode="overwrite")
    stream = fx.readings_from_events(streaming.stream_table(spark, src, ev.schema))
    q = streaming.score_production(stream, resolve, out, ckpt, available_now=False)
    q.processAllAvailable()
    workflow.promote(spark, paths, "m2", "scorewatch", PROMOTED_AT)
    sinks.write_batch(prep.time_slice(ev, "ts", lo=fx.SWITCH_DAY), src, mode="append")
    q.processAllAvailable()
    q.stop()
    return tables.predictions(spark, out).select("pid", "process_time", "predicted_quality", "model_version")


def retrain_window_streamed(spark, sf_dir):
    """The window to retrain on, from the predictions that the production model's stream stored
    and the labels landed by then (D2, M13)."""
    return _streamed_window(spark, sf_dir, "m1")


def _streamed_window(spark, sf_dir, version):
    paths = workflow.LoopPaths(fresh_dir(spark, "loop"))
    workflow.promote(spark, paths, version, "scorewatch", "2024-01-11 18:00:00")
    stream = streaming.stream_event_readings(spark, sf_dir)
    _run_stream(streaming.stream_score(stream, _rule_scorer(version), paths.predictions, paths.checkpoint))
    return workflow.drift_window(spark, paths, _labels(spark, sf_dir), DRIFT_SEEN_AT)


def scored_counts(spark, sf_dir):
    """Rows read and rows skipped for a missing feature, observed while a batch and a stream are
    written (T11, C1, C2)."""
    res = training.fit_grid(spark, _train_frame(spark, sf_dir), "DecisionTree", fresh_dir(spark, "models"),
                            grid=SMALL_GRIDS["DecisionTree"])
    model = scoring.load_model(next(iter(res.model_paths.values())))
    rows = _gappy(spark, sf_dir)
    batch, seen = scoring.score_counted(model, rows, "m")
    sinks.write_batch(batch, fresh_dir(spark, "pred"))
    src = fresh_dir(spark, "readings")
    sinks.write_batch(rows, src)
    stream = streaming.observed(streaming.stream_readings(spark, src))
    q = streaming.stream_score(stream, lambda r: scoring.score(model, r, "m"), fresh_dir(spark, "pred"),
                               fresh_dir(spark, "ckpt"))
    _run_stream(q)
    return small_frame(spark, [{"path": "batch", **seen.get}, {"path": "stream", **streaming.observed_counts(q)}],
                       "path string, rows long, skipped long")


# --- fitted models (rows-only checks) --------------------------------------------------------
def _fit_score(spark, sf_dir, family, parallelism=3, grid=None, readings=None):
    res = training.fit_grid(spark, _train_frame(spark, sf_dir), family, fresh_dir(spark, "models"),
                            window=" - ".join(fx.TRAIN_WINDOW), parallelism=parallelism, grid=grid)
    rid, _ = training.best_of(res)
    model = scoring.load_model(res.model_paths[rid])
    return scoring.score(model, fx.noisy(spark, sf_dir) if readings is None else readings, rid)


def _gappy(spark, sf_dir):
    """Readings with injected null and NaN features."""
    d = F.col("duration")
    return fx.noisy(spark, sf_dir).withColumn(
        "duration", F.when(d == 50, F.lit(None)).when(d == 60, F.lit(float("nan"))).otherwise(d))


def _fitted_rows(family):
    def query(spark, sf_dir):
        scored = _fit_score(spark, sf_dir, family, grid=SMALL_GRIDS[family], readings=_gappy(spark, sf_dir))
        return scored.groupBy("pid", "process_time").agg(
            F.count_distinct("model_version").alias("versions"), F.count("predicted_quality").alias("rows"))
    query.__doc__ = f"""Which readings a fitted {family} pipeline scores (M3, C1, T11): those with all features."""
    return query


def _walked(family):
    def query(spark, sf_dir):
        res = training.fit_grid(spark, _train_frame(spark, sf_dir), family, fresh_dir(spark, "models"),
                                grid=SMALL_GRIDS[family])
        return tree_rows.disagreements(spark, next(iter(res.model_paths.values())), _gappy(spark, sf_dir))
    query.__doc__ = f"""Predictions of a fitted {family} pipeline against its trees as a node table (M5-M8):
    rows scored, and those on which the two differ."""
    return query


def fit_confusion_total(spark, sf_dir):
    """Confusion counts of a fitted run sum to its test rows (K5, M1)."""
    res = training.fit_grid(spark, _train_frame(spark, sf_dir), "DecisionTree", fresh_dir(spark, "models"),
                            grid=SMALL_GRIDS["DecisionTree"], split="hash")
    return res.confusion.agg(F.sum("count").cast("long").alias("rows"))


def forest_score(spark, sf_dir):
    """Random-forest grid (9 fits), best by accuracy, all readings scored."""
    return _fit_score(spark, sf_dir, "RandomForest")


def tree_score(spark, sf_dir):
    """Decision-tree grid (3 fits), best run scores all readings."""
    return _fit_score(spark, sf_dir, "DecisionTree")


def boosted_score(spark, sf_dir):
    """Boosted-tree grid (9 fits, GBT in place of XGBoost)."""
    return _fit_score(spark, sf_dir, "GBT")


def retrain_window(spark, sf_dir):
    """The window that drift asks to retrain on."""
    return workflow.retrain_window(drift_days(spark, sf_dir))


def retrain(spark, sf_dir):
    """The whole loop (M13, R1-R8, C2, C3): train on the first window, promote,
    stream-score the first arrival; drift days give the window to retrain on;
    promote again (the old run is demoted), swap the live stream's model."""
    paths = workflow.LoopPaths(fresh_dir(spark, "loop"))
    src = fresh_dir(spark, "arrivals")
    readings, labels = fx.noisy(spark, sf_dir), _labels(spark, sf_dir)
    ev = fx.events(spark, sf_dir)
    rid = workflow.train_round(spark, paths, readings, labels, *fx.TRAIN_WINDOW,
                              at="2024-01-11 17:00:00")
    workflow.promote(spark, paths, rid, "scorewatch", "2024-01-11 18:00:00")
    sinks.write_batch(prep.time_slice(ev, "ts", hi=fx.SWITCH_DAY), src, mode="overwrite")
    stream = fx.perturb(fx.readings_from_events(streaming.stream_table(spark, src, ev.schema)))
    q = workflow.score_stream(spark, paths, stream, available_now=False)
    q.processAllAvailable()
    # the KPI of the predictions it stored drifts: the first drift days are the new window
    window = workflow.drift_window(spark, paths, labels, DRIFT_SEEN_AT).first()
    if window is not None:
        rid2 = workflow.train_round(spark, paths, readings, labels, f"{window['start_day']} 00:00:00",
                                    DRIFT_SEEN_AT, at="2024-01-21 00:30:00")
        if rid2 is not None:
            workflow.promote(spark, paths, rid2, "scorewatch", "2024-01-21 01:00:00")
    q = workflow.score_stream(spark, paths, stream, query=q, available_now=False)
    sinks.write_batch(prep.time_slice(ev, "ts", lo=fx.SWITCH_DAY), src, mode="append")
    q.processAllAvailable()
    q.stop()
    return tables.predictions(spark, paths.predictions)


def stream_score_model(spark, sf_dir):
    """Stream scoring with a fitted pipeline (C2 with Spark ML)."""
    res = training.fit_grid(spark, _train_frame(spark, sf_dir), "DecisionTree", fresh_dir(spark, "models"),
                            window=" - ".join(fx.TRAIN_WINDOW))
    rid, _ = training.best_of(res)
    model = scoring.load_model(res.model_paths[rid])
    out, ckpt = fresh_dir(spark, "pred"), fresh_dir(spark, "ckpt")
    stream = fx.perturb(streaming.stream_event_readings(spark, sf_dir))
    _run_stream(streaming.stream_score(stream, lambda r: scoring.score(model, r, rid), out, ckpt))
    return tables.predictions(spark, out)


QUERIES: dict[str, Query] = {
    "kpi_daily": kpi_daily,
    "kpi_from_tables": kpi_from_tables,
    "kpi_incremental": kpi_incremental,
    "kpi_on_arrival": kpi_on_arrival,
    "kpi_delta": kpi_delta,
    "confusion_delta": confusion_delta,
    "class_share_delta": class_share_delta,
    "kpi_streams": kpi_streams,
    "training_set": training_set,
    "due_slice": due_slice,
    "rule_label": rule_label,
    "confusion_matrix": confusion_matrix,
    "confusion_log": confusion_log,
    "class_share": class_share,
    "drift_days": drift_days,
    "kpi_stitched": kpi_stitched,
    "kpi_after": kpi_after,
    "kpi_stitch": kpi_stitch,
    "kpi_grades": kpi_grades,
    "confusion_grades": confusion_grades,
    "accuracy_grades": accuracy_grades,
    "run_confusion": run_confusion,
    "retrain_window": retrain_window,
    "what_if": what_if,
    "accuracy_by_model": accuracy_by_model,
    "hash_split": hash_split,
    "hash_sample": hash_sample,
    "grid_best": grid_best,
    "best_run_per_family": best_run_per_family,
    "pending_grid": pending_grid,
    "run_log": run_log,
    "latest_tag": latest_tag,
    "run_details": run_details,
    "run_search": run_search,
    "production_run": production_run,
    "promote_cycle": promote_cycle,
    "demote": demote,
    "production_intervals": production_intervals,
    "promotion_log": promotion_log,
    "in_production": in_production,
    "production_intervals_by_experiment": production_intervals_by_experiment,
    "in_production_by_experiment": in_production_by_experiment,
    "describe_value": describe_value,
    "label_index": label_index,
    "random_sample": random_sample,
    "random_split": random_split,
    "random_split_total": random_split_total,
    "random_sample_outside": random_sample_outside,
    "valid_features": valid_features,
    "combined_readings": combined_readings,
    "batch_write_slices": batch_write_slices,
    "slice_files": slice_files,
    "measured_readings": measured_readings,
    "scaled_features": scaled_features,
    "epoch_readings": epoch_readings,
    "stream_score_rule": stream_score_rule,
    "stream_readings": stream_readings,
    "stream_labels": stream_labels,
    "stream_predictions": stream_predictions,
    "stream_swap": stream_swap,
    "stream_promote": stream_promote,
    "retrain_window_streamed": retrain_window_streamed,
    "scored_counts": scored_counts,
    "forest_walk": _walked("RandomForest"),
    "tree_walk": _walked("DecisionTree"),
    "boosted_walk": _walked("GBT"),
    "forest_rows": _fitted_rows("RandomForest"),
    "tree_rows": _fitted_rows("DecisionTree"),
    "boosted_rows": _fitted_rows("GBT"),
    "fit_confusion_total": fit_confusion_total,
    "forest_score": forest_score,
    "tree_score": tree_score,
    "boosted_score": boosted_score,
    "stream_score_model": stream_score_model,
    "retrain": retrain,
}
