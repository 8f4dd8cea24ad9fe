"""Fitted trees as a table of nodes, and their evaluation with joins alone.

``node_table`` reads the trees of a saved pipeline as rows (tree, node, feature, threshold,
left, right, votes, value, weight). ``walk`` moves every (row, tree) one level at a time:
an equi-join on (tree, node), of which one side is the model, whose size the fit bounds by trees
and depth, so Spark broadcasts it as measured. The answer is that of the ``PipelineModel``
itself, which the registered queries count row by row: a check of the values that
``transform`` gives, and a way to score where Spark ML is not at hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.session import small_frame, store
from scorewatch.sources.tables import FEATURES


def _estimator_folder(spark: SparkSession, path: str) -> tuple[str, str]:
    """Folder and class of the tree stage of a saved pipeline."""
    import json

    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/stages/*")
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(glob):
        folder = f.getPath().toString()
        name = json.loads(spark.read.text(f"{folder}/metadata").first()[0])["class"].rsplit(".", 1)[1]
        if name in ("DecisionTreeClassificationModel", "RandomForestClassificationModel", "GBTClassificationModel"):
            return folder, name
    raise ValueError(f"no tree stage below {path}")


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the trees saved in the pipeline at ``path``. Inner nodes have a feature and a
    threshold (left if the value is not larger), leaves have votes per class or a value."""
    folder, kind = _estimator_folder(spark, path)
    raw = spark.read.parquet(f"{folder}/data")
    if "nodeData" in raw.columns:
        rows = raw.select(F.col("treeID").alias("tree"), "nodeData.*")
        weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("tree", "metadata", "weights").drop("metadata")
        rows = rows.join(weights, "tree")
    else:
        rows = raw.select(F.lit(0).alias("tree"), *raw.columns, F.lit(1.0).alias("weights"))
    inner = F.col("leftChild") >= 0
    return rows.select(
        "tree", F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.col("impurityStats").alias("votes"), F.col("prediction").alias("value"),
        F.col("weights").alias("weight"), F.lit(kind).alias("kind"))


def walk(nodes: DataFrame, rows: DataFrame, features: Sequence[str] = FEATURES,
         scales: Sequence[float] | None = None) -> DataFrame:
    """``rows`` with ``prediction``, the class index that the trees give. ``rows`` has a unique
    column ``row`` and no missing features; ``scales`` divide the features (boosted pipelines)."""
    x = [F.col(c).cast("double") for c in features]
    if scales is not None:
        x = [c * F.lit(1.0 / s if s else 0.0) for c, s in zip(x, scales)]
    nodes = store(nodes, "tree-nodes")
    kind = nodes.select("kind").first()[0]
    trees = nodes.filter("node = 0").select("tree")
    numbers = F.array(*[F.lit(r[0]) for r in trees.orderBy("tree").collect()])       # one per tree
    at = rows.select("row", F.array(*x).alias("x")).withColumn("tree", F.explode(numbers))
    at = at.withColumn("node", F.lit(0))
    inner = nodes.filter("feature IS NOT NULL").select("tree", "node", "feature", "threshold", "left", "right")
    depth = _depth(inner)
    for _ in range(depth):
        step = at.join(inner, ["tree", "node"], "left")
        down = F.when(F.col("x")[F.col("feature")] <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = step.select("row", "x", "tree", F.coalesce(down, F.col("node")).alias("node"))
    leaf = at.join(nodes.select("tree", "node", "votes", "value", "weight"), ["tree", "node"])
    own = F.array_sort(F.collect_list(F.struct("tree", "votes", "value", "weight")))
    got = leaf.groupBy("row").agg(own.alias("own"))
    if kind == "GBTClassificationModel":
        total = F.aggregate("own", F.lit(0.0), lambda acc, t: acc + t["value"] * t["weight"])
        index = F.when(total > 0, 1.0).otherwise(0.0)
    else:
        share = F.transform("own", lambda t: F.transform(
            t["votes"], lambda v: v / F.aggregate(t["votes"], F.lit(0.0), lambda a, b: a + b)))
        summed = F.aggregate(F.slice(share, 2, F.size(share)), share[0],
                             lambda acc, s: F.zip_with(acc, s, lambda a, b: a + b))
        index = F.array_position(summed, F.array_max(summed)).cast("double") - 1
    return rows.join(got.select("row", index.alias("prediction")), "row")


def _depth(inner: DataFrame) -> int:
    """Levels below the roots; the nodes of a fitted model are few and bounded by its depth."""
    parent = {(r["tree"], c): (r["tree"], r["node"]) for r in inner.select("tree", "node", "left", "right").collect()
              for c in (r["left"], r["right"])}
    deep = {}

    def level(k):
        if k not in deep:
            deep[k] = 0 if k not in parent else 1 + level(parent[k])
        return deep[k]
    return max(map(level, parent), default=0)


def disagreements(spark: SparkSession, path: str, readings: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(rows, disagreements): rows that the saved pipeline at ``path`` scores, and those whose
    predicted label differs from the one of the node table."""
    model = PipelineModel.load(path)
    labels = model.stages[0].labels
    rows = store(readings.select(*features).withColumn("row", F.monotonically_increasing_id()), "walk-rows")
    scored = model.transform(rows).select("row", F.col("predicted_quality").alias("fitted"))
    scales = next((s.std.toArray().tolist() for s in model.stages if hasattr(s, "std")), None)
    valid = rows
    for c in features:
        valid = valid.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    names = small_frame(spark, [{"prediction": float(i), "walked": x} for i, x in enumerate(labels)],
                        "prediction double, walked string")
    walked = walk(node_table(spark, path), valid, features, scales).join(names, "prediction")
    both = scored.join(walked.select("row", "walked"), "row", "full")
    return both.agg(F.count("fitted").alias("rows"),
                    F.count_if(~F.col("fitted").eqNullSafe(F.col("walked"))).alias("disagreements"))
