"""Splits, label index, features, scaling and grids of tree classifiers (Spark ML).

A grid is fitted against train/test frames persisted once; fits run a few at
a time on the same session (Spark schedules their jobs side by side). Every fit
yields run-log rows, confusion counts and a saved ``PipelineModel``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.functions.columns import hash_bucket
from scorewatch.operators import registry
from scorewatch.operators.monitor import confusion
from scorewatch.session import cut_lineage, small_frame
from scorewatch.sources.tables import FEATURES

# --- fixed values of the reference's training procedure ----------------------
SPLIT_WEIGHTS, SPLIT_SEED = (0.8, 0.2), 1234
FOREST_SEED, TREE_SEED = 512, 1028
FOREST_TREES, DEPTHS = (10, 25, 50), (3, 10, 5)
BOOSTED_ROUNDS, BOOSTED_RATES = (10, 25, 50), (0.1, 0.2, 0.3)
# -----------------------------------------------------------------------------


def _grid(**axes: Iterable) -> list[dict]:
    names = list(axes)
    return [dict(zip(names, combo)) for combo in itertools.product(*axes.values())]


FAMILIES = {
    "RandomForest": (lambda p: RandomForestClassifier(
        labelCol="indexedLabel", featuresCol="features", numTrees=p["numTrees"],
        maxDepth=p["maxDepth"], seed=FOREST_SEED),
        _grid(numTrees=FOREST_TREES, maxDepth=DEPTHS)),
    "DecisionTree": (lambda p: DecisionTreeClassifier(
        labelCol="indexedLabel", featuresCol="features", maxDepth=p["maxDepth"], seed=TREE_SEED),
        _grid(maxDepth=DEPTHS)),
    # Boosted trees: the XGBoost grid re-aimed at Spark's GBT, on scaled features.
    "GBT": (lambda p: GBTClassifier(
        labelCol="indexedLabel", featuresCol="features", maxIter=p["numTrees"],
        stepSize=p["learningRate"], seed=FOREST_SEED),
        _grid(numTrees=BOOSTED_ROUNDS, learningRate=BOOSTED_RATES)),
}


SCALED = {"GBT"}                # families whose pipeline scales the features


# --- splits -------------------------------------------------------------------
def hash_split(df: DataFrame, key: str = "pid", buckets: int = 10,
               train_buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Deterministic split on md5 of the key, independent of partitioning (M1)."""
    b = hash_bucket(key, buckets)
    return df.filter(b < train_buckets), df.filter(b >= train_buckets)


def random_split(df: DataFrame, weights=SPLIT_WEIGHTS, seed: int = SPLIT_SEED):
    """``randomSplit`` as the reference does; depends on the partitioning."""
    return df.randomSplit(list(weights), seed)


def split_counts(df: DataFrame, key: str = "pid", buckets: int = 10,
                 train_buckets: int = 8) -> DataFrame:
    side = F.when(hash_bucket(key, buckets) < train_buckets, "train").otherwise("test")
    return df.groupBy(side.alias("split")).agg(F.count(F.lit(1)).alias("rows"))


# --- labels and features ---------------------------------------------------------
def label_frequencies(df: DataFrame, label: str = "quality") -> DataFrame:
    """Label -> index by descending frequency, ties by label text: the order
    ``StringIndexer`` assigns (A7, M2). The window runs over one row per class."""
    counts = (df.groupBy(F.col(label).cast("string").alias("label"))
              .agg(F.count(F.lit(1)).alias("count")))
    w = Window.orderBy(F.col("count").desc(), F.col("label").asc())
    return counts.withColumn("label_index", (F.row_number().over(w) - 1).cast("double"))


def fit_label_index(df: DataFrame, label: str = "quality") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="indexedLabel").fit(df)


def assembler(features: Sequence[str] = FEATURES, out: str = "features") -> VectorAssembler:
    """Feature vector; rows with a null/NaN feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol=out).setHandleInvalid("skip")


def scoring_counts(features: Sequence[str] = FEATURES) -> list:
    """Aggregates to observe: all rows, and those with a null or NaN feature, which
    ``assembler`` skips (T11)."""
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c))
    return [F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("skipped")]


def scaler(inp: str = "features_assembler", out: str = "features") -> StandardScaler:
    """Pipeline stage dividing a feature vector by its per-feature sample
    standard deviation, without centring (M4)."""
    return StandardScaler(inputCol=inp, outputCol=out, withStd=True, withMean=False)


def scale(df: DataFrame, features: Sequence[str] = FEATURES, suffix: str = "_scaled") -> DataFrame:
    """Each feature divided by its sample standard deviation (A8), as plain columns.

    The deviations come from one aggregation (partial aggregates combine
    map-side; three numbers reach the driver, as a fitted ``StandardScaler``
    holds them), then a projection divides: no vectors, no UDF. Rows with a
    missing feature are kept here (their scaled value is null); the pipeline
    stage ``scaler`` skips them with the assembler. A zero deviation scales to 0,
    as ``StandardScaler`` does.
    """
    sd = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in features]).first()
    cols = []
    for c in features:
        s = sd[c]
        x = F.col(c).cast("double")
        cols.append((x / F.lit(s) if s else x * F.lit(0.0)).alias(f"{c}{suffix}"))
    return df.select(*df.columns, *cols)


# --- rule grid (exact, SQL-checkable stand-in for fitted grids) -----------------
def rule_grid_hits(frame: DataFrame, grid: Sequence[Mapping], label: str = "quality",
                   temp: str = "temp", pressure: str = "pressure",
                   pressure_hi: float = 134) -> DataFrame:
    """Hits of each rule candidate ``temp BETWEEN lo AND hi AND pressure
    BETWEEN 0 AND pressure_hi -> 1`` against the label, all in one pass.

    Candidates become conditional sums of a single aggregation instead of a
    join with the data, so the data is read once whatever the grid size.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, g in enumerate(grid):
        pred = F.when(F.col(temp).between(g["lo"], g["hi"]) &
                      F.col(pressure).between(0, pressure_hi), 1).otherwise(0)
        aggs.append(F.count_if(pred == F.col(label)).alias(f"_h{i}"))
    wide = frame.agg(*aggs)
    cells = [F.struct(F.lit(int(g["lo"])).alias("lo"), F.lit(int(g["hi"])).alias("hi"),
                      F.col(f"_h{i}").cast("long").alias("hits")) for i, g in enumerate(grid)]
    return (wide.select(F.explode(F.array(*cells)).alias("_c"), "_n")
            .select("_c.*", (F.col("_c.hits") / F.col("_n")).alias("accuracy")))


# --- fitted grids ------------------------------------------------------------------
def run_id_for(family: str, params: Mapping, window: str) -> str:
    text = family + "|" + "|".join(f"{k}={params[k]}" for k in sorted(params)) + "|" + window
    return hashlib.md5(text.encode()).hexdigest()


@dataclass
class GridResult:
    runs: DataFrame                     # run_id, model, params..., accuracy
    log: DataFrame                      # run-log rows (params, metric, tag)
    confusion: DataFrame                # run_id, predicted_quality, quality, count
    model_paths: dict[str, str] = field(default_factory=dict)


@dataclass
class Prepared:
    """A training frame ready for any number of grids: written once, split once."""

    train: DataFrame
    test: DataFrame
    indexer: object                     # fitted label index
    skipped: int                        # rows the assembler skips for a missing feature (T11)

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def prepare(frame: DataFrame, split: str = "random", features: Sequence[str] = FEATURES,
            label: str = "quality") -> Prepared:
    """Write the training frame to the shared checkpoint folder, counting its skipped rows on the way,
    split it, persist both sides, fit the label index.

    Every fit (many passes each) then reads one materialized frame, a lost
    executor recomputes from it rather than from the join, and the random split
    sees the same rows on recomputation.
    """
    seen = Observation("training")
    frame = cut_lineage(frame.select("pid", *features, label).observe(seen, *scoring_counts(features)))
    train, test = hash_split(frame) if split == "hash" else random_split(frame)
    return Prepared(train.persist(StorageLevel.MEMORY_AND_DISK),
                    test.persist(StorageLevel.MEMORY_AND_DISK),
                    fit_label_index(frame, label), seen.get["skipped"])


def stages(family: str, params: Mapping, indexer, features: Sequence[str] = FEATURES) -> list:
    """Pipeline stages of one fit: label index, feature vector, scaler (boosted
    trees), estimator, label text."""
    to_text = IndexToString(inputCol="prediction", outputCol="predicted_quality",
                            labels=indexer.labels)
    vector = [assembler(features, "features_assembler"), scaler()] if family in SCALED \
        else [assembler(features)]
    return [indexer, *vector, FAMILIES[family][0](params), to_text]


def nested(family: str, grid: Sequence[Mapping]) -> list[list[dict]]:
    """Grid points that one fit answers, the largest first: boosting is sequential, so with
    one seed a model of fewer rounds is the beginning of one with more. Other families'
    points stand alone (a forest draws its samples for all its trees at once)."""
    if family != "GBT":
        return [[dict(g)] for g in grid]
    groups: dict[tuple, list[dict]] = {}
    for g in grid:
        groups.setdefault(tuple(sorted((k, v) for k, v in g.items() if k != "numTrees")), []).append(dict(g))
    return [sorted(g, key=lambda p: -p["numTrees"]) for g in groups.values()]


def cut_boosted(model: PipelineModel, rounds: int) -> PipelineModel:
    """The pipeline whose boosted stage stops after its first ``rounds`` trees."""
    stages = []
    for s in model.stages:
        if isinstance(s, GBTClassificationModel):
            java, gateway = s._java_obj, s._java_obj.trees()
            sc = SparkContext._active_spark_context
            kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
            trees = sc._gateway.new_array(kind, rounds)
            weights = sc._gateway.new_array(sc._jvm.double, rounds)
            for i in range(rounds):
                trees[i], weights[i] = gateway[i], float(s.treeWeights[i])
            cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
                java.uid(), trees, weights, java.numFeatures())
            java.copyValues(cut, java.extractParamMap())
            s = GBTClassificationModel(cut)
        stages.append(s)
    return PipelineModel(stages)


def fit_grid(spark: SparkSession, frame: DataFrame | Prepared, family: str, model_dir: str,
             window: str = "", grid: Sequence[Mapping] | None = None,
             finished: DataFrame | None = None, split: str = "random",
             parallelism: int = 3, features: Sequence[str] = FEATURES,
             label: str = "quality", experiment: str = registry.EXPERIMENT, seq: int = 0) -> GridResult:
    """Fit one family's grid on ``frame`` (M5-M12), skipping finished points.

    ``finished``: run log of earlier rounds; grid points whose params (and data
    window) already have a run are not refitted. Pass a ``Prepared`` frame to
    share it between families. Confusion counts are collected per fit while the
    test side is persisted: (number of classes)^2 rows each.
    """
    grid = [dict(g) for g in (grid or FAMILIES[family][1])]
    for g in grid:
        g.update(model=family, model_data_date=window)
    keys = list(grid[0])
    if finished is not None:
        gdf = small_frame(spark, [{k: str(v) for k, v in g.items()} for g in grid],
                          ", ".join(f"`{k}` string" for k in keys))
        done = registry.run_params(registry.of_experiment(finished, experiment), keys)
        todo = {tuple(r[k] for k in keys) for r in
                registry.pending_grid(gdf, done, keys).collect()}   # bounded by the grid
        grid = [g for g in grid if tuple(str(g[k]) for k in keys) in todo]

    if not grid:
        empty = spark.createDataFrame([], "run_id string, accuracy double")
        return GridResult(runs=empty, log=spark.createDataFrame([], registry.RUN_LOG_SCHEMA),
                          confusion=None)
    own = not isinstance(frame, Prepared)
    data = prepare(frame, split, features, label) if own else frame
    evaluator = MulticlassClassificationEvaluator(labelCol="indexedLabel",
                                                  predictionCol="prediction",
                                                  metricName="accuracy")

    def logged(params: dict, model: PipelineModel):
        rid = run_id_for(family, params, window)
        path = f"{model_dir.rstrip('/')}/{rid}"
        model.write().overwrite().save(path)
        # evaluated as loaded: a fresh forest's training summary drags the session into the
        # tasks, which fails once the session has observed a frame
        pred = PipelineModel.load(path).transform(data.test)
        pairs = pred.select("predicted_quality", F.col(label).cast("string").alias("quality"))
        counts = [{"run_id": rid, **r.asDict()} for r in confusion(pairs).collect()]
        return rid, params, evaluator.evaluate(pred), path, counts

    def fitted(points: list[dict]):
        model = Pipeline(stages=stages(family, points[0], data.indexer, features)).fit(data.train)
        return [logged(points[0], model)] + [logged(p, cut_boosted(model, p["numTrees"])) for p in points[1:]]

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            done_runs = [r for runs in pool.map(fitted, nested(family, grid)) for r in runs]
    finally:
        if own:
            data.release()

    rows = [{"run_id": rid, **{k: str(v) for k, v in p.items()}, "accuracy": float(acc),
             "skipped_rows": data.skipped, "spark_model": path}
            for rid, p, acc, path, _ in done_runs]
    schema = ("run_id string, " + ", ".join(f"`{k}` string" for k in keys)
              + ", accuracy double, skipped_rows long, spark_model string")
    runs = small_frame(spark, rows, schema)
    log = registry.log_runs(runs, params=keys, metrics=["accuracy", "skipped_rows"],
                            tags={"state": registry.DEV}, tag_cols=["spark_model"],
                            experiment=experiment, seq=seq)
    conf = small_frame(spark, [c for *_, counts in done_runs for c in counts],
                       "run_id string, predicted_quality string, quality string, count long")
    return GridResult(runs=runs, log=log, confusion=conf,
                      model_paths={rid: path for rid, _, _, path, _ in done_runs})


def best_of(result: GridResult) -> tuple[str, float]:
    """Best run of a grid by accuracy (ties: smallest run id)."""
    top = registry.best_run(result.runs, "accuracy").first()
    return top["run_id"], top["accuracy"]

