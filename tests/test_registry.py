"""Run-log operators: logging, search, skip finished grid points, best run,
promotion and production state (SURVEY §2.11, traps T13-T15)."""

import pyspark.sql.functions as F

from scorewatch.operators import registry
from tests.helpers import ts


def _runs(spark):
    return spark.createDataFrame(
        [("r1", 10, 3, 0.91), ("r2", 10, 5, 0.95), ("r3", 25, 3, 0.95), ("r4", 25, 5, 0.80)],
        "run_id string, numTrees int, maxDepth int, accuracy double")


def _log(spark):
    return registry.log_runs(_runs(spark), params=["numTrees", "maxDepth"], metrics=["accuracy"],
                             tags={"state": "dev"}, logged_at=F.lit(ts("2024-01-01 00:00:00"))
                             .cast("timestamp_ntz"))


def test_log_rows(spark):
    log = _log(spark)
    assert log.count() == 4 * 4
    assert log.columns == [f.name for f in registry.RUN_LOG_SCHEMA]
    r = log.filter("run_id = 'r2' and key = 'accuracy'").first()
    assert r["kind"] == "metric" and float(r["value"]) == 0.95


def test_search_all_predicates(spark):
    got = registry.search_runs(_log(spark), params={"numTrees": 10, "maxDepth": 5})
    assert [r["run_id"] for r in got.collect()] == ["r2"]
    assert registry.search_runs(_log(spark), params={"numTrees": 99}).count() == 0
    assert registry.search_runs(_log(spark), tags={"state": "dev"}).count() == 4


def test_pending_grid(spark):
    grid = spark.createDataFrame([(t, d) for t in (10, 25, 50) for d in (3, 5)],
                                 "numTrees int, maxDepth int")
    done = registry.run_params(_log(spark), ["numTrees", "maxDepth"])
    pend = {(r["numTrees"], r["maxDepth"]) for r in
            registry.pending_grid(grid, done, ["numTrees", "maxDepth"]).collect()}
    assert pend == {(50, 3), (50, 5)}


def test_best_run_ties_and_empty(spark):
    best = registry.best_run(_runs(spark), "accuracy").collect()
    assert [r["run_id"] for r in best] == ["r2"]          # tie 0.95: smallest id (T14)
    assert registry.best_run(_runs(spark).filter("accuracy > 2"), "accuracy").count() == 0
    fam = {r["numTrees"]: r["run_id"] for r in
           registry.best_per_group(_runs(spark), "numTrees", "accuracy", "maxDepth").collect()}
    assert fam == {10: "r2", 25: "r3"}


def test_promotion_cycle(spark):
    log = _log(spark)
    assert registry.production_run(log).count() == 0          # none yet (T15)
    p1 = registry.promote(spark, log, "r2", "u", "2024-01-02 00:00:00")
    assert p1.filter("value = 'ex_production'").count() == 0
    log = log.unionByName(p1)
    assert [r["run_id"] for r in registry.production_run(log).collect()] == ["r2"]
    p2 = registry.promote(spark, log, "r3", "u", "2024-01-03 00:00:00")
    # one frame holds the demotion and the promotion
    assert {(r["run_id"], r["value"]) for r in p2.filter("key = 'state'").collect()} == {
        ("r2", "ex_production"), ("r3", "production")}
    log = log.unionByName(p2)
    assert [r["run_id"] for r in registry.production_run(log).collect()] == ["r3"]
    details = {r["key"]: r["value"] for r in registry.run_details(log, "r2").collect()}
    assert details["state"] == "ex_production" and details["production_end"] == "2024-01-03 00:00:00"


def test_intervals_and_log_over_promotions(spark):
    promos = spark.createDataFrame(
        [("a", ts("2024-01-01 00:00:00"), 1), ("b", ts("2024-01-02 00:00:00"), 2),
         ("a", ts("2024-01-03 00:00:00"), 3)], "run_id string, ts timestamp_ntz, seq long")
    iv = [(r["run_id"], r["production_end"]) for r in
          registry.production_intervals(promos).orderBy("seq").collect()]
    assert iv == [("a", ts("2024-01-02 00:00:00")), ("b", ts("2024-01-03 00:00:00")), ("a", None)]
    pl = registry.promotion_log(promos)
    assert pl.count() == 5
    assert pl.filter("value = 'ex_production'").orderBy("seq").select("run_id").collect()[0][0] == "a"


def test_search_uses_latest_values(spark):
    t = ts("2024-01-01 00:00:00")                # one time: the append number decides
    log = spark.createDataFrame(
        [("r1", "tag", "state", "production", t, "default", 0),
         ("r1", "tag", "state", "ex_production", t, "default", 1),
         ("r2", "tag", "state", "dev", t, "default", 0),
         ("r2", "tag", "state", "production", t, "default", 2),
         ("r2", "param", "lo", "5", t, "default", 0)], registry.RUN_LOG_SCHEMA)
    got = [r[0] for r in registry.search_runs(log, tags={"state": "production"}).collect()]
    assert got == ["r2"]                         # r1 once matched, but its latest value differs
    both = registry.search_runs(log, params={"lo": 5}, tags={"state": "production"}).collect()
    assert [r[0] for r in both] == ["r2"]
    assert registry.search_runs(log, params={"lo": 5}, tags={"state": "dev"}).count() == 0


def test_promotions_at_one_time_and_in_two_experiments(spark):
    log = spark.createDataFrame([], registry.RUN_LOG_SCHEMA)
    at = "2024-01-02 00:00:00"
    for run, exp in (("r1", "a"), ("x1", "b"), ("r2", "a")):
        log = log.unionByName(registry.promote(spark, log, run, "u", at, exp))
    assert [r.run_id for r in registry.production_run(log, "a").collect()] == ["r2"]
    assert [r.run_id for r in registry.production_run(log, "b").collect()] == ["x1"]
    log = log.unionByName(registry.demote(spark, log, "r2", "u", at, "a"))
    assert registry.production_run(log, "a").collect() == []
    assert [r.run_id for r in registry.production_run(log).collect()] == ["x1"]
    assert [r.seq for r in log.select("seq").distinct().orderBy("seq").collect()] == [0, 1, 2, 3]
    found = registry.search_runs(log, tags={"state": "production"}, experiment="a").collect()
    assert found == []


def test_confusion_is_stored_and_found_by_run(spark):
    from scorewatch.session import fresh_dir
    path = fresh_dir(spark, "t-confusion")
    for run, n in (("r1", 3), ("r2", 5)):
        registry.log_confusion(spark.createDataFrame(
            [(run, "1", 1, n), (run, "0", 1, 2)], "run_id string, predicted_quality string, quality int, count long"), path)
    got = registry.read_confusion(spark, path, "r2")
    assert sorted(tuple(r) for r in got.collect()) == [("r2", "0", "1", 2), ("r2", "1", "1", 5)]
    assert "EqualTo(run_id,r2)" in got._jdf.queryExecution().executedPlan().toString()


def test_default_log_time_is_utc(spark):
    import datetime as dt
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        at = registry.log_runs(_runs(spark), params=["maxDepth"]).first()["logged_at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert abs((at - now).total_seconds()) < 600
