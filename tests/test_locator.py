"""Finding the days that labels touch reads the label's pid blocks, whenever labels land."""

import pyspark.sql.functions as F
import pytest

from scorewatch.operators import locator, monitor
from scorewatch.session import fresh_dir
from scorewatch.sources import tables
from tests.helpers import ts

PRED = "pid long, process_time timestamp_ntz, predicted_quality string, model_version string"
LAB = "pid long, qualitycheck_time timestamp_ntz, quality int"


def stored(spark, rows, span=10):
    path, find = fresh_dir(spark, "t-pred"), locator.Locator(fresh_dir(spark, "t-loc"), span)
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):                     # two appends
        locator.append_predictions(spark.createDataFrame(part, PRED), path, find)
    return tables.predictions(spark, path), find


def read_folders(df):
    return {r[0].split("pid_block=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_only_the_blocks_of_the_labels_are_read(spark):
    rows = [(i, ts(f"2024-01-{1 + i // 10:02d} 10:00:00"), "1", "a") for i in range(90)]
    preds, find = stored(spark, rows + [(31, ts("2024-01-20 10:00:00"), "0", "a")])
    new = spark.createDataFrame([(31, None, 1), (74, ts("2024-03-01 00:00:00"), 0), (None, None, 1)], LAB)
    assert read_folders(find.entries(spark, new)) == {"3", "7"}
    assert sorted(str(r[0]) for r in find.days(new.select("pid")).collect()) == ["2024-01-04", "2024-01-08", "2024-01-20"]
    assert monitor.touched_days(preds, new, find).exceptAll(monitor.touched_days(preds, new)).count() == 0
    plan = find.entries(spark, new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [pid_block" in plan


def test_the_predictions_of_other_days_are_not_read(spark):
    rows = [(i, ts(f"2024-01-{1 + i // 10:02d} 10:00:00"), "1", "a") for i in range(90)]
    preds, find = stored(spark, rows)
    lpath, kpi = fresh_dir(spark, "t-lab"), fresh_dir(spark, "t-kpi")
    locator.write_by_pid(spark.createDataFrame([(i, ts("2024-02-01 00:00:00"), 1) for i in range(90)], LAB), lpath, 10)
    new = spark.createDataFrame([(35, ts("2024-02-01 00:00:00"), 1)], LAB)
    assert monitor.refresh_kpi(spark.read.parquet(lpath), preds, new, kpi, locator=find) == 1
    assert [(str(r.window_day), r["count"]) for r in monitor.read_kpi(spark, kpi).collect()] == [("2024-01-04", 10)]
    assert read_folders(locator.in_blocks(spark.read.parquet(lpath), [3])) == {"3"}


@pytest.mark.parametrize("use", [True, False])
def test_on_time_late_and_timeless_labels_refresh_their_days(spark, use):
    rows = [(i, ts(f"2024-01-{i:02d} 10:00:00"), "1", "a") for i in range(1, 13)] + [
        (10, ts("2024-01-02 11:00:00"), "0", "a")]               # two days of one pid
    preds, find = stored(spark, rows, span=4)
    first = spark.createDataFrame([(i, ts(f"2024-01-{i + 1:02d} 00:00:00"), 1) for i in (1, 2, 6, 7)], LAB)
    on_time, late, timeless = (10, ts("2024-01-12 00:00:00"), 1), (1, ts("2024-01-12 00:00:00"), 0), (7, None, 0)
    for new in ([on_time, late, timeless], [late], [timeless]):
        kpi, new = fresh_dir(spark, "t-kpi"), spark.createDataFrame(new, LAB)
        labels = first.unionByName(new)
        monitor.refresh_kpi(first, preds, first, kpi, locator=find if use else None)
        monitor.refresh_kpi(labels, preds, new, kpi, locator=find if use else None)
        assert sorted(monitor.read_kpi(spark, kpi).collect()) == sorted(monitor.daily_kpi(labels, preds).collect())


def test_without_entries_or_labels(spark):
    find = locator.Locator(fresh_dir(spark, "t-none"))
    one = spark.createDataFrame([(1, None, 1)], LAB)
    assert find.days(one).collect() == []
    _, find = stored(spark, [(1, ts("2024-01-01 00:00:00"), "1", "a"), (2, None, "1", "a")])
    assert find.days(one.limit(0)).collect() == [] and find.days(spark.createDataFrame([(2,)], "pid long")).collect() == []
