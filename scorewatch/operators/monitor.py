"""Model-quality monitoring: predictions joined to late labels, daily KPI,
confusion, class shares, drift days, stitched and what-if comparisons.

Join strategy for predictions x labels (both grow with the data, so neither is
broadcast): labels are first reduced to one row per (``pid``, label) with its
count, combined map-side, so a hot ``pid`` collapses to as many rows as it has
different labels. Each prediction then meets that pid's few label rows, whose
counts weight it: the join never emits the pairs of a duplicated key, and the
result equals counting the rows of the plain inner join. Both sides reach the
join through plain exchanges on ``pid``, so AQE splits the predictions of a hot
``pid`` over several tasks. No key list is sampled, nothing is collected, and
any set of label classes, numeric or text, is counted as it comes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.functions.columns import correct_flag, pct, ts_lit, window_day
from scorewatch.session import path_exists, store

KPI_BAND = (80.0, 100.0)
MAX_CLASSES = 1000          # label classes that a pivoted confusion matrix may have as columns


def label_counts(labels: DataFrame) -> DataFrame:
    """One row per (pid, quality) with the number of its label rows (``_nl``)."""
    return labels.groupBy("pid", "quality").agg(F.count(F.lit(1)).alias("_nl"))


def labelled(labels: DataFrame, predictions: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """Prediction rows (pid, ``cols``, predicted_quality) beside each label of
    their pid, weighted ``_nl``; unlabelled predictions drop out."""
    return predictions.select("pid", *cols, "predicted_quality").join(label_counts(labels), "pid")


def pair_counts(labels: DataFrame, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``predictions JOIN labels USING (pid)`` counted by (``by``...,
    ``predicted_quality``, ``quality``), without forming the pairs."""
    return (labelled(labels, predictions, by).groupBy(*by, "predicted_quality", "quality")
            .agg(F.sum("_nl").cast("long").alias("count")))


def compare(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Row-level join of predictions and labels with the 1/0 correctness flag."""
    return (predictions.join(labels, "pid")
            .withColumn("accurate_prediction", correct_flag("predicted_quality", "quality")))


def with_share(counts: DataFrame, keys: Sequence[str], label_col: str) -> DataFrame:
    """Counts per (keys, label) beside the keys' total and the share of it."""
    # Day total beside each count (W1); the input is already a few rows per day.
    total = F.sum("count").over(Window.partitionBy(*keys)).cast("long")
    return (counts.withColumn("total", total)
            .withColumn("ratio", pct("count", "total"))
            .select(*keys, label_col, "count", "total", "ratio")
            .orderBy(*keys, label_col))


def flag_counts(labels: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right and all pairs of ``predictions JOIN labels USING (pid)`` per ``keys``
    (columns of ``predictions``), weighted by label counts. Output: keys..., _right, _all."""
    j = labelled(labels, predictions, keys)
    right = correct_flag("predicted_quality", "quality") * F.col("_nl")
    return j.groupBy(*keys).agg(F.sum(right).cast("long").alias("_right"),
                                F.sum("_nl").cast("long").alias("_all"))


def kpi_rows(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KPI rows of ``daily(keys..., _right, total)``: one per key and correctness with pairs."""
    cells = F.array(
        F.struct(F.lit("Accurate").alias("accurate_prediction"), F.col("_right").alias("count")),
        F.struct(F.lit("Inaccurate").alias("accurate_prediction"),
                 (F.col("total") - F.col("_right")).alias("count")))
    return (daily.select(*keys, "total", F.explode(cells).alias("_c"))
            .select(*keys, "_c.accurate_prediction", "_c.count", "total")
            .filter(F.col("count") > 0)
            .withColumn("ratio", pct("count", "total")))


def kpi_of_pairs(pairs: DataFrame) -> DataFrame:
    """Daily KPI of already joined rows (process_time, predicted_quality, quality)."""
    day = window_day("process_time").alias("window_day")
    right = F.sum(correct_flag("predicted_quality", "quality")).cast("long").alias("_right")
    return kpi_rows(pairs.groupBy(day).agg(right, F.count(F.lit(1)).alias("total")), ["window_day"])


def daily_kpi(labels: DataFrame, predictions: DataFrame, by_version: bool = False,
              ordered: bool = True) -> DataFrame:
    """Share of right and wrong predictions per day.

    Labelled predictions only (inner join); versions are pooled unless
    ``by_version``. A day without wrong (or right) predictions has no such row.
    Right and all pairs are summed in one aggregation after the join, so the
    day total needs no window (it equals ``sum(count) OVER (PARTITION BY day)``).
    ``ordered=False`` skips the final sort when the KPI feeds another operator.
    """
    keys = ["window_day"] + (["model_version"] if by_version else [])
    preds = predictions.withColumn("window_day", window_day("process_time"))
    daily = flag_counts(labels, preds, keys).withColumnRenamed("_all", "total")
    out = kpi_rows(daily, keys)
    return out.orderBy(*keys, "accurate_prediction") if ordered else out


def accuracy(labels: DataFrame, predictions: DataFrame,
             by: Sequence[str] = ("model_version",)) -> DataFrame:
    """Matching / all over labelled predictions (A6, DataFrame form)."""
    return flag_counts(labels, predictions, list(by)).select(
        *by, (F.col("_right") / F.col("_all")).alias("accuracy"), F.col("_all").alias("n"))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count by (predicted, actual) over a frame holding both columns (A1)."""
    return df.groupBy(*by, "predicted_quality", "quality").agg(F.count(F.lit(1)).alias("count"))


def joined_confusion(labels: DataFrame, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of predictions joined to their labels."""
    return pair_counts(labels, predictions, by)


def confusion_matrix(counts: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """Pivot confusion counts: one row per predicted label, one column per class,
    missing cells 0 (A2). The classes are those of the counts (null labels as
    ``quality_null``) unless given; a count outside given classes is an error, and so are
    more than ``MAX_CLASSES`` classes: a table with a column each is then the wrong form."""
    found = [r[0] for r in counts.select("quality").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} label classes: use the unpivoted confusion counts")
    if classes is None:
        classes = sorted((c for c in found if c is not None), key=lambda c: (str(type(c)), c))
        classes += [None] * (None in found)
    elif unknown := [c for c in found if c not in classes]:
        raise ValueError(f"counts hold classes that are not asked for: {unknown}")
    cells = [F.coalesce(F.sum(F.when(F.col("quality").eqNullSafe(F.lit(c)), F.col("count"))), F.lit(0))
             .cast("long").alias(f"quality_{'null' if c is None else c}") for c in classes]
    return counts.groupBy("predicted_quality").agg(F.sum("count").alias("_n"), *cells).drop("_n") \
        .orderBy("predicted_quality")


def daily_class_share(predictions: DataFrame, label_col: str = "predicted_quality") -> DataFrame:
    """Count per (day, predicted class) with the day's share (A4)."""
    counts = (predictions.withColumn("window_day", window_day("process_time"))
              .groupBy("window_day", label_col).agg(F.count(F.lit(1)).alias("count")))
    return with_share(counts, ["window_day"], label_col)


def drift_days(kpi: DataFrame, band: tuple[float, float] = KPI_BAND,
               keys: Sequence[str] = ("window_day",)) -> DataFrame:
    """Days whose share of right predictions leaves the band.

    A day with no ``Accurate`` row counts as 0 %.
    """
    acc = F.sum(F.when(F.col("accurate_prediction") == "Accurate", F.col("ratio"))
                .otherwise(F.lit(0.0)))
    daily = kpi.groupBy(*keys).agg(acc.alias("accurate_ratio"))
    lo, hi = band
    return (daily.filter((F.col("accurate_ratio") < lo) | (F.col("accurate_ratio") > hi))
            .orderBy(*keys))


def stitch(kpi_before: DataFrame, kpi_after: DataFrame, switch_day: str,
           versions: tuple[str, str] = ("m1", "m2")) -> DataFrame:
    """First model's KPI before the switch day, the second's from it on."""
    day = F.col("window_day")
    a = kpi_before.filter(day < F.to_date(F.lit(switch_day))) \
        .withColumn("model_version", F.lit(versions[0]))
    b = kpi_after.filter(day >= F.to_date(F.lit(switch_day))) \
        .withColumn("model_version", F.lit(versions[1]))
    return a.unionByName(b).orderBy("window_day", "accurate_prediction")


def stitch_models(labels: DataFrame, before: DataFrame, after: DataFrame,
                  switch_day: str) -> DataFrame:
    """``stitch`` computed from predictions: the first model's predictions
    before the switch day and the second's from it on, one KPI by version.
    Same rows as ``stitch(daily_kpi(before), daily_kpi(after))`` with one label
    reduction; the bounds on ``process_time`` reach each model's scan."""
    t, cut = F.col("process_time"), ts_lit(switch_day)
    return daily_kpi(labels, before.filter(t < cut).unionByName(after.filter(t >= cut)),
                     by_version=True)


def kpi_after(kpi: DataFrame, day: str) -> DataFrame:
    """KPI rows after a given day (D4), of a stored KPI table."""
    return kpi.filter(F.col("window_day") > F.to_date(F.lit(day)))


def daily_kpi_after(labels: DataFrame, predictions: DataFrame, day: str) -> DataFrame:
    """``kpi_after(daily_kpi(...), day)`` computed from the predictions of those days
    alone: the bound on ``process_time`` reaches the scan."""
    later = predictions.filter(F.col("process_time") >= (ts_lit(day) + F.expr("INTERVAL 1 DAY")))
    return daily_kpi(labels, later)


def what_if(labels: DataFrame, scored: Mapping[str, DataFrame]) -> DataFrame:
    """Daily KPI of several models over the same history, per version."""
    frames = list(scored.values())
    allp = frames[0]
    for f in frames[1:]:
        allp = allp.unionByName(f)
    return daily_kpi(labels, allp, by_version=True)


def in_production(labels: DataFrame, predictions: DataFrame, promotions: DataFrame,
                  order: Sequence[str] = ("ts", "seq"), by: Sequence[str] = ()) -> DataFrame:
    """Labelled predictions attributed to the run in production at their
    ``process_time``, summarised per run (D5).

    ``promotions``: run_id, ts, seq; each promotion ends the previous run's
    production interval. ``by``: columns of both frames (the experiment) within which
    runs replace each other. Right and all pairs are first summed per
    ``process_time`` (map-side, so a hot instant is one row and the type of
    ``pid`` plays no part), then each instant takes the latest promotion at or
    before it: an as-of lookup over the global time order
    (``ordering.carry_forward``), one path whatever the number of promotions.
    """
    from scorewatch.operators.ordering import carry_forward
    t_col, seq = order
    none = F.lit(None).cast("long")
    starts = promotions.select(
        *by, F.col(t_col).alias("_t"), F.lit(0).alias("_tb"), F.col(seq).cast("long").alias("_seq"),
        F.col("run_id").cast("string").alias("_run"), none.alias("_right"), none.alias("_all"))
    rows = flag_counts(labels, predictions, [*by, "process_time"]).select(
        *by, F.col("process_time").alias("_t"), F.lit(1).alias("_tb"), F.lit(0).cast("long").alias("_seq"),
        F.lit(None).cast("string").alias("_run"), "_right", "_all")
    both = store(starts.unionByName(rows), "production-rows")
    tagged = carry_forward(both, ["_t", "_tb", "_seq"], "_run", "run_id", by=by)
    return (tagged.filter((F.col("_tb") == 1) & F.col("run_id").isNotNull()).groupBy(*by, "run_id").agg(
        F.sum("_all").cast("long").alias("readings"),
        F.sum("_right").cast("long").alias("accurate"))
        .withColumn("ratio", pct("accurate", "readings"))
        .orderBy(*by, "run_id"))


def touched_days(predictions: DataFrame, new_labels: DataFrame, locator=None) -> DataFrame:
    """Days holding a prediction whose label is among ``new_labels``.

    With a ``locator.Locator`` only its folders of the labels' own pids are read, whenever
    the labels land. Without one the pid and time of every prediction are looked through.
    Both sides are reduced (distinct, map-side) before the semi-join, so a hot pid is a few rows.
    """
    pids = new_labels.select("pid")
    if locator is not None:
        return locator.days(pids)
    p = predictions.select("pid", window_day("process_time").alias("window_day")).distinct()
    return p.join(pids.distinct(), "pid", "left_semi").select("window_day").distinct()


def refresh_kpi(labels: DataFrame, predictions: DataFrame, new_labels: DataFrame,
                kpi_path: str, by_version: bool = False, locator=None) -> int:
    """Incremental KPI: recompute only the days touched by newly arrived labels
    and overwrite just those day partitions of the KPI table (dynamic
    partition overwrite). Returns the number of days rewritten.

    The touched days come from the ``locator`` (see ``touched_days``) as a stored table that
    the predictions are semi-joined with; on a table partitioned by ``process_day`` the join
    prunes the scan to those days (dynamic partition pruning). Labels are semi-joined with
    the pids of these predictions before they are reduced; of labels stored by pid block
    (``locator.write_by_pid``) only the blocks of these pids are read.
    """
    days = store(touched_days(predictions, new_labels, locator), "kpi-days")
    n = days.count()
    if not n:
        return 0
    if "process_day" in predictions.columns:
        preds = predictions.join(days.withColumnRenamed("window_day", "process_day"),
                                 "process_day", "left_semi")
    else:
        preds = (predictions.withColumn("window_day", window_day("process_time"))
                 .join(days, "window_day", "left_semi").drop("window_day"))
    if locator is not None and "pid_block" in labels.columns:
        from scorewatch.operators.locator import blocks_of, in_blocks
        labels = in_blocks(labels, blocks_of(preds, locator.span))
    own = labels.join(preds.select("pid").distinct(), "pid", "left_semi")
    kpi = daily_kpi(own, preds, by_version=by_version, ordered=False)
    (kpi.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("window_day").parquet(kpi_path))
    return n


KPI_COLUMNS = "accurate_prediction string, count long, total long, ratio double"


def read_kpi(spark, kpi_path: str, by_version: bool = False) -> DataFrame:
    """The stored KPI table; without rows if no refresh has written yet."""
    extra = "model_version string, " if by_version else ""
    schema = f"{extra}{KPI_COLUMNS}, window_day date"
    if not path_exists(spark, kpi_path):
        kpi = spark.createDataFrame([], schema)
    else:
        kpi = spark.read.schema(schema).parquet(kpi_path)
    return kpi.select("window_day", *["model_version"] * by_version,
                      "accurate_prediction", "count", "total", "ratio")
