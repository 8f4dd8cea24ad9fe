"""Splits, label index, features and a fitted grid (invariants, SURVEY §5c)."""

import pyspark.sql.functions as F
from pyspark.ml.feature import StringIndexer

from scorewatch.operators import prep, registry, scoring, training
from scorewatch.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_label_index_matches_string_indexer(spark):
    for rows in ([(1,), (1,), (0,)], [(0,), (1,)], [(0,), (0,), (1,)]):
        df = spark.createDataFrame(rows, "quality int")
        want = StringIndexer(inputCol="quality", outputCol="i").fit(df).labels
        got = [r["label"] for r in training.label_frequencies(df).orderBy("label_index").collect()]
        assert got == list(want)                             # T10, ties alphabetical


def test_hash_split_is_partition_independent(spark):
    df = fx.readings(spark, SF_SMALL)
    a, _ = training.hash_split(df)
    b, _ = training.hash_split(df.repartition(7))
    assert sorted(r[0] for r in a.select("pid").collect()) == \
        sorted(r[0] for r in b.select("pid").collect())      # T16


def test_assembler_skips_null_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 1.0, 1.0)], "temp double, pressure double,"
                               " duration double")
    assert training.assembler().transform(df).count() == 1    # T11
    assert df.agg(*training.scoring_counts()).first().asDict() == {"rows": 2, "skipped": 1}
    assert prep.valid_features(df, ["temp", "pressure", "duration"]).count() == 1


def test_scale_divides_by_sample_stddev(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 2.0, 7.0), (5.0, 8.0, 2.0)],
                               "temp double, pressure double, duration double")
    out = training.scale(df).collect()
    sd = df.agg(F.stddev_samp("temp")).first()[0]
    assert abs(out[0]["temp_scaled"] - 1.0 / sd) < 1e-12
    # the pipeline stage gives the same numbers
    va = training.assembler(out="features_assembler")
    ml = training.scaler().fit(va.transform(df)).transform(va.transform(df)).collect()
    assert abs(ml[0]["features"][0] - out[0]["temp_scaled"]) < 1e-12


def test_rule_grid_one_pass_equals_per_candidate(spark):
    frame = spark.createDataFrame([(10.0, 5.0, 1), (100.0, 200.0, 0), (3.0, 1.0, 0)],
                                  "temp double, pressure double, quality int")
    grid = [{"lo": 5, "hi": 120}, {"lo": 0, "hi": 50}]
    got = {(r["lo"], r["hi"]): r["hits"] for r in training.rule_grid_hits(frame, grid).collect()}
    assert got == {(5, 120): 3, (0, 50): 2}


def test_tree_grid_fit_and_score(spark, tmp_path):
    frame = prep.training_set(fx.noisy(spark, "/root/testdata/sf0.01"),
                              fx.labels(spark, "/root/testdata/sf0.01"), *fx.TRAIN_WINDOW)
    res = training.fit_grid(spark, frame, "DecisionTree", str(tmp_path / "models"),
                            window="w", split="hash", parallelism=2)
    runs = res.runs.collect()
    assert len(runs) == 3 and all(0.0 <= r["accuracy"] <= 1.0 for r in runs)
    share = frame.groupBy("quality").count().agg(F.max("count")).first()[0] / frame.count()
    rid, acc = training.best_of(res)
    assert acc >= share                                     # better than the majority class
    model = scoring.load_model(res.model_paths[rid])
    readings = fx.noisy(spark, SF_SMALL)                    # no quality column (T12)
    scored = scoring.score(model, readings, rid)
    assert scored.count() == readings.count()
    assert set(scored.columns) == {"pid", "process_time", "predicted_quality", "model_version"}
    assert res.log.count() == 3 * 7   # maxDepth, model, window; accuracy, skipped; state, model
    assert registry.run_details(res.log, rid).filter("key = 'spark_model'").first()["value"] \
        == res.model_paths[rid]
    # rerun with the log: every grid point is finished, nothing is refitted
    again = training.fit_grid(spark, frame, "DecisionTree", str(tmp_path / "models"),
                              window="w", split="hash", finished=res.log)
    assert again.runs.count() == 0 and again.confusion is None


def test_rows_per_file_cap(spark, tmp_path):
    import glob
    from scorewatch.sources import sinks
    df = spark.range(500).coalesce(1)
    sinks.write_batch(df, str(tmp_path / "t"), mode="overwrite", max_records_per_file=50)
    assert len(glob.glob(str(tmp_path / "t" / "*.parquet"))) == 10          # K3
    sinks.write_batch(df, str(tmp_path / "t"), mode="append")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000          # K2


def test_props_fast_path_equals_json_parser(spark):
    df = spark.createDataFrame([('{"k": 12}',), ('{"k": -3}',), ('{"k": 4.5}',), ('{"a": 1, "k": 7}',),
                                ('{"k":8}',), (None,), ('not json',)], "props string")
    got = df.select(fx.props_k().alias("a"), F.get_json_object("props", "$.k").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)


def test_profile_forms_agree(spark):
    from scorewatch.operators import profile
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (5.0, 7.0)], "temp double, pressure double")
    text = {r["summary"]: r for r in profile.describe_text(df, ["temp", "pressure"]).collect()}
    typed = {r["column"]: r for r in profile.describe_long(df, ["temp", "pressure"]).collect()}
    assert float(text["mean"]["temp"]) == typed["temp"]["mean"] == 3.0
    assert int(text["count"]["pressure"]) == typed["pressure"]["count"] == 3
    assert float(text["max"]["pressure"]) == typed["pressure"]["max"]


def test_forest_and_boosted_fits_on_a_small_grid(spark, tmp_path):
    from pyspark.ml.feature import StandardScalerModel
    frame = prep.training_set(fx.noisy(spark, "/root/testdata/sf0.01"),
                              fx.labels(spark, "/root/testdata/sf0.01"), *fx.TRAIN_WINDOW)
    data = training.prepare(frame, split="hash")
    share = frame.groupBy("quality").count().agg(F.max("count")).first()[0] / frame.count()
    for family, point in (("RandomForest", {"numTrees": 5, "maxDepth": 5}), ("GBT", {"numTrees": 5, "learningRate": 0.3})):
        res = training.fit_grid(spark, data, family, str(tmp_path / family), grid=[point])
        rid, acc = training.best_of(res)
        assert acc >= share - 0.02
        model = scoring.load_model(res.model_paths[rid])
        scaled = [s for s in model.stages if isinstance(s, StandardScalerModel)]
        assert len(scaled) == (family == "GBT")
        total = res.confusion.agg(F.sum("count")).first()[0]
        assert total == data.test.dropna(subset=["temp", "pressure", "duration"]).count()
        gappy = fx.noisy(spark, SF_SMALL).withColumn("temp", F.when(F.col("pid") % 4 > 0, F.col("temp")))
        scored, seen = scoring.score_counted(model, gappy, rid)
        rows = len(scored.collect())
        assert rows + seen.get["skipped"] == gappy.count() == seen.get["rows"] and seen.get["skipped"] > 0
    data.release()


def test_a_cut_boosted_model_is_the_one_fitted_with_fewer_rounds(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    frame = fx.noisy(spark, SF_SMALL).join(fx.labels(spark, SF_SMALL).select("pid", "quality"), "pid")
    data = training.prepare(frame, split="hash")
    fits = {n: Pipeline(stages=training.stages("GBT", {"numTrees": n, "learningRate": 0.2}, data.indexer)).fit(data.train)
            for n in (3, 8)}
    cut = training.cut_boosted(fits[8], 3)
    cut.write().overwrite().save(str(tmp_path / "cut"))
    cut = PipelineModel.load(str(tmp_path / "cut"))
    gbt = [m.stages[-2] for m in (cut, fits[3])]
    assert gbt[0].getNumTrees == 3 and list(gbt[0].treeWeights) == list(gbt[1].treeWeights)
    assert [t.toDebugString.split("\n", 1)[1] for t in gbt[0].trees] == [t.toDebugString.split("\n", 1)[1] for t in gbt[1].trees]
    a, b = (m.transform(data.test).select("pid", "predicted_quality", "rawPrediction").orderBy("pid").collect()
            for m in (cut, fits[3]))
    assert a == b and len(a) > 0
    data.release()


def test_nested_grids_fit_once_per_rate():
    groups = training.nested("GBT", training.FAMILIES["GBT"][1])
    assert len(groups) == 3 and all([p["numTrees"] for p in g] == [50, 25, 10] for g in groups)
    assert all(len(g) == 1 for g in training.nested("RandomForest", training.FAMILIES["RandomForest"][1]))


def test_walk_of_a_saved_model_equals_the_library(spark, tmp_path):
    from pyspark.ml import Pipeline
    from scorewatch.operators import tree_rows
    from scorewatch.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    frame = fx.noisy(spark, SF_SMALL).join(fx.labels(spark, SF_SMALL).select("pid", "quality"), "pid")
    data = training.prepare(frame, split="hash")
    for family, params in (("RandomForest", {"numTrees": 4, "maxDepth": 6}), ("GBT", {"numTrees": 4, "learningRate": 0.3})):
        path = str(tmp_path / family)
        Pipeline(stages=training.stages(family, params, data.indexer)).fit(data.train).save(path)
        got = tree_rows.disagreements(spark, path, frame).first()
        assert got["rows"] == frame.count() and got["disagreements"] == 0
        nodes = tree_rows.node_table(spark, path)
        # a table with one threshold moved does not agree any more
        top = nodes.withColumn("threshold", F.when(F.col("node") == 0, F.col("threshold") - 30).otherwise(F.col("threshold")))
        row = frame.withColumn("row", F.monotonically_increasing_id())
        std = data.train.agg(*[F.stddev_samp(c) for c in training.FEATURES]).first()
        walks = [tree_rows.walk(n, row, scales=list(std) if family == "GBT" else None) for n in (nodes, top)]
        assert walks[0].select("row", "prediction").exceptAll(walks[1].select("row", "prediction")).count() > 0
    data.release()
