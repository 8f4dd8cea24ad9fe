import pyspark.sql.functions as F

from scorewatch.llm import common


def test_samples_are_bounded_and_whole_when_small(spark):
    rows = spark.range(20_000)
    assert rows.filter(common.sampled(30_000, 20_000, "id")).count() == 20_000
    assert 800 < rows.filter(common.sampled(1000, 20_000, "id")).count() < 1200
    share = 10**15 * 30_000 // 10**12                     # a trillion rows: still a share above zero
    assert share > 0


def test_fresh_names_ignore_case(spark):
    df = spark.range(1).select(F.col("id").alias("RID"), F.lit(1).alias("rid_"))
    assert common.fresh_name(df, "rid") == "rid__"


def test_lower_case_touches_ascii_only(spark):
    got = spark.createDataFrame([("ÀBZ aİ",)], "t string").select(common.ascii_lower(F.col("t"))).first()[0]
    assert got == "Àbz aİ"
