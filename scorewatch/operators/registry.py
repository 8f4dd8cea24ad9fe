"""Run tracking as tables: an append-only key/value run log and the queries
users run against it (search, skip finished grid points, best run, run
details, production state, promotions and production intervals).

Run log schema: ``run_id, kind ('param'|'metric'|'tag'), key, value, logged_at,
experiment, seq`` with text values. ``seq`` numbers the appends, so "latest" does
not depend on clocks or on text: of equal times the later append counts.
"Latest value" is always an aggregate (``max`` of a struct ordered by ``seq``)
rather than a per-group sort, so it combines map-side and a run with very many
rows does not end up sorted in one task. Production state is per experiment.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.operators.ordering import lag_in_order, lead_in_order

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("logged_at", T.TimestampNTZType(), True),
    T.StructField("experiment", T.StringType(), True),
    T.StructField("seq", T.LongType(), True),
])

PRODUCTION, EX_PRODUCTION, DEV = "production", "ex_production", "dev"
EXPERIMENT = "default"
ORDER = ("seq", "logged_at")


def _text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def log_runs(runs: DataFrame, params: Sequence[str] = (), metrics: Sequence[str] = (),
             tags: Mapping[str, str] | None = None, run_id: str = "run_id",
             logged_at: F.Column | None = None, tag_cols: Sequence[str] = (),
             experiment: str = EXPERIMENT, seq: int | F.Column = 0) -> DataFrame:
    """Key/value log rows for a frame with one row per run.

    ``params``, ``metrics`` and ``tag_cols`` name columns of ``runs``;
    ``tags`` are constant for every run. ``seq`` is the append's number
    (``next_seq``); the default time is the UTC wall clock.
    """
    cells = [F.struct(F.lit("param").alias("kind"), F.lit(p).alias("key"), _text(p).alias("value"))
             for p in params]
    cells += [F.struct(F.lit("metric").alias("kind"), F.lit(m).alias("key"), _text(m).alias("value"))
              for m in metrics]
    cells += [F.struct(F.lit("tag").alias("kind"), F.lit(k).alias("key"), F.lit(v).alias("value"))
              for k, v in (tags or {}).items()]
    cells += [F.struct(F.lit("tag").alias("kind"), F.lit(t).alias("key"), _text(t).alias("value"))
              for t in tag_cols]
    at = logged_at if logged_at is not None else F.convert_timezone(
        None, F.lit("UTC"), F.localtimestamp())
    number = seq if isinstance(seq, F.Column) else F.lit(seq)
    return (runs.select(F.col(run_id).cast("string").alias("run_id"), at.alias("logged_at"),
                        F.lit(experiment).alias("experiment"), number.cast("long").alias("seq"),
                        F.explode(F.array(*cells)).alias("_c"))
            .select("run_id", "_c.kind", "_c.key", "_c.value", "logged_at", "experiment", "seq"))


def next_seq(log: DataFrame) -> int:
    """The number of the next append to a log."""
    last = log.agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1


@contextmanager
def claimed(spark: SparkSession, folder: str, read_log, patience: float = 60.0):
    """Own the next append number while the rows are appended: yields (number, log it follows).

    The claim is a file created only if absent, so of two writers one gets the number. The
    other waits until the first has appended and marked the number done, then reads the log
    again, and so sees what it has to follow. A body that fails without appending gives its number
    back. A writer that was lost in between leaves its claim: after ``patience`` seconds others raise,
    naming the file to delete. Stores whose create is not exclusive need a lock of their own.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def file(name) -> object:
        return jvm.org.apache.hadoop.fs.Path(base, str(name))

    until = time.monotonic() + patience
    while True:
        log = read_log()
        seq = next_seq(log)
        busy = fs.exists(file(seq - 1)) and not fs.exists(file(f"{seq - 1}.done"))
        if not busy and fs.createNewFile(file(seq)):
            break
        if time.monotonic() > until:
            raise RuntimeError(f"append number {seq - busy} is claimed but not done: {file(seq - busy).toString()}")
        time.sleep(0.2)
    try:
        yield seq, log
    except BaseException:
        if next_seq(read_log()) <= seq:
            fs.delete(file(seq), False)
        else:
            fs.createNewFile(file(f"{seq}.done"))
        raise
    fs.createNewFile(file(f"{seq}.done"))


def latest_values(log: DataFrame, keys: Sequence[str] = ("run_id", "kind", "key"),
                  order: Sequence[str] = ORDER, value: str = "value") -> DataFrame:
    """Latest ``value`` per ``keys`` by ``order`` (ties: larger order columns win)."""
    latest = F.max(F.struct(*order, value)).alias("_l")
    return log.groupBy(*keys).agg(latest).select(
        *keys, *[F.col("_l")[o].alias(o) for o in order], F.col("_l")[value].alias(value))


def run_params(log: DataFrame, keys: Sequence[str], kind: str = "param") -> DataFrame:
    """Wide form: one row per run, one text column per requested key."""
    cur = latest_values(log.filter((F.col("kind") == kind) & F.col("key").isin(list(keys))))
    return cur.groupBy("run_id").pivot("key", list(keys)).agg(F.first("value"))


def of_experiment(log: DataFrame, experiment: str | None) -> DataFrame:
    """Log rows of one experiment (all of them if None)."""
    return log if experiment is None else log.filter(F.col("experiment") == experiment)


def search_runs(log: DataFrame, params: Mapping[str, object] | None = None,
                tags: Mapping[str, object] | None = None,
                experiment: str | None = None) -> DataFrame:
    """Runs whose current params/tags equal all given values (R2).

    A run whose latest value of a key equals the wanted value has at least one
    row with that value, so candidates come from the value-matching rows
    alone (selective, aggregated map-side). The latest values are then checked
    for the candidates only: one aggregation by run over their rows, each
    predicate's latest value being ``max`` of (seq, time, value).
    """
    preds = [("param", k, str(v)) for k, v in (params or {}).items()]
    preds += [("tag", k, str(v)) for k, v in (tags or {}).items()]
    log = of_experiment(log, experiment)
    if not preds:
        return log.select("run_id").distinct()

    def key_is(kind, key):
        return (F.col("kind") == kind) & (F.col("key") == key)

    hit = matched = None
    for kind, key, val in preds:
        h, m = key_is(kind, key), key_is(kind, key) & (F.col("value") == val)
        hit = h if hit is None else (hit | h)
        matched = m if matched is None else (matched | m)
    seen = [F.max(F.when(key_is(kind, key) & (F.col("value") == val), 1)).alias(f"_m{i}")
            for i, (kind, key, val) in enumerate(preds)]
    cand = log.filter(matched).groupBy("run_id").agg(*seen).dropna().select("run_id")
    latest = [F.max(F.when(key_is(kind, key), F.struct(*ORDER, "value")))["value"]
              .alias(f"_v{i}") for i, (kind, key, _) in enumerate(preds)]
    cur = log.filter(hit).join(cand, "run_id", "left_semi").groupBy("run_id").agg(*latest)
    ok = None
    for i, (_, _, val) in enumerate(preds):
        c = F.col(f"_v{i}") == val
        ok = c if ok is None else (ok & c)
    return cur.filter(ok).select("run_id")


def run_exists(log: DataFrame, params: Mapping[str, object]) -> bool:
    """Whether any run has all these params (R3, single-point form)."""
    return search_runs(log, params=params).limit(1).count() > 0


def pending_grid(grid: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid points with no finished run of equal params (R3): an anti-join on the
    distinct finished params."""
    keys = list(keys)
    done = finished.select(*[_text(k).alias(f"_done_{k}") for k in keys]).distinct()
    return grid.join(done, [_text(grid[k]) == done[f"_done_{k}"] for k in keys], "left_anti")


def best_run(runs: DataFrame, metric: str, ties: Sequence[str] = ("run_id",)) -> DataFrame:
    """Top run by ``metric`` (desc), ties by ``ties`` (asc); empty in, empty out.

    Planned as a top-1 per partition and a merge of the partition winners."""
    return runs.orderBy(F.col(metric).desc(), *[F.col(t).asc() for t in ties]).limit(1)


def best_per_group(runs: DataFrame, group: str, metric: str, tie: str) -> DataFrame:
    """Best run per group: highest ``metric``, then lowest numeric ``tie``."""
    best = F.max(F.struct(F.col(metric), (-F.col(tie)).alias("_neg"),
                          F.struct(*[c for c in runs.columns if c != group]).alias("_row")))
    return (runs.groupBy(group).agg(best.alias("_b"))
            .select(group, "_b._row.*").select(*runs.columns))


def run_details(log: DataFrame, run_id: str) -> DataFrame:
    """Current params, metrics and tags of one run, one row per (kind, key)."""
    return latest_values(log.filter(F.col("run_id") == run_id))


def production_run(log: DataFrame, experiment: str | None = None) -> DataFrame:
    """Runs of an experiment whose current ``state`` tag is ``production`` (R6);
    empty if none (T15)."""
    state = latest_values(of_experiment(log, experiment)
                          .filter((F.col("kind") == "tag") & (F.col("key") == "state")))
    return state.filter(F.col("value") == PRODUCTION).select("run_id", "logged_at", "seq")


def _tag_log(runs: DataFrame, tags: Sequence[tuple[str, str]], at: str, experiment: str,
             seq: int) -> DataFrame:
    return log_runs(runs, tags=dict(tags), logged_at=F.lit(at).cast("timestamp_ntz"),
                    experiment=experiment, seq=seq)


def promote(spark: SparkSession, log: DataFrame, run_id: str, user: str, at: str,
            experiment: str = EXPERIMENT, seq: int | None = None) -> DataFrame:
    """Tag rows for one promotion, demotion of the experiment's current runs
    included (R7, R8).

    One frame to append at once (T13): the old run gets ``ex_production`` and an
    end time, the new one ``production`` and a start time, all under the next
    append number, ``seq`` if it was claimed (``claimed``).
    """
    seq = next_seq(log) if seq is None else seq
    cur = production_run(log, experiment).filter(F.col("run_id") != run_id)
    old = _tag_log(cur, [("state", EX_PRODUCTION), ("production_marked_by", user),
                         ("production_end", at)], at, experiment, seq)
    new = _tag_log(spark.range(1).select(F.lit(run_id).alias("run_id")),
                   [("state", PRODUCTION), ("production_marked_by", user),
                    ("production_start", at), ("production_end", "")], at, experiment, seq)
    return old.unionByName(new)


def demote(spark: SparkSession, log: DataFrame, run_id: str, user: str, at: str,
           experiment: str = EXPERIMENT) -> DataFrame:
    """Tag rows ending one run's production."""
    return _tag_log(spark.range(1).select(F.lit(run_id).alias("run_id")),
                    [("state", EX_PRODUCTION), ("production_marked_by", user),
                     ("production_end", at)], at, experiment, next_seq(log))


def log_confusion(counts: DataFrame, path: str) -> None:
    """Append the confusion counts of runs (run_id, predicted_quality, quality,
    count) to the stored confusion table (K5)."""
    (counts.select("run_id", F.col("predicted_quality").cast("string"),
                   F.col("quality").cast("string").alias("quality"), F.col("count").cast("long"))
     .write.mode("append").parquet(path))


def read_confusion(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The stored confusion counts of one run; the filter reaches the scan."""
    return (spark.read.schema("run_id string, predicted_quality string, quality string, count long")
            .parquet(path).filter(F.col("run_id") == run_id))


def _experiment(promotions: DataFrame) -> list[str]:
    return ["experiment"] if "experiment" in promotions.columns else []


def promotion_log(promotions: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """State tag rows for a sequence of promotions (R7 over history).

    ``promotions``: run_id, ts, seq (unique tie-breaker), experiment if there are several. Each
    promotion tags the new run ``production`` and, except the first of its experiment, the
    previous run ``ex_production`` at the same time.
    """
    by = _experiment(promotions)
    order = [*order, *by]
    prev = lag_in_order(promotions.select("run_id", *order), order[:len(order) - len(by)], "run_id", "_prev", by=by)
    new = prev.select(F.col("run_id").cast("string").alias("run_id"),
                      F.lit("state").alias("key"), F.lit(PRODUCTION).alias("value"), *order)
    old = (prev.filter(F.col("_prev").isNotNull())
           .select(F.col("_prev").cast("string").alias("run_id"),
                   F.lit("state").alias("key"), F.lit(EX_PRODUCTION).alias("value"), *order))
    return new.unionByName(old)


def production_intervals(promotions: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Production interval per promotion: start, and end = the next promotion's start in the
    same experiment (R9; all are one experiment if there is no such column)."""
    by = _experiment(promotions)
    nxt = lead_in_order(promotions.select("run_id", *order, *by), list(order), order[0], "_end", by=by)
    return nxt.select("run_id", F.col(order[0]).alias("production_start"),
                      F.col("_end").alias("production_end"), *order[1:], *by)
