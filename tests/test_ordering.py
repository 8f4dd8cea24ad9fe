"""Global-order operators equal the single-partition window they replace."""

import random

import pyspark.sql.functions as F
import pytest
from pyspark.sql import Window

from scorewatch.operators.ordering import carry_forward, lag_in_order, lead_in_order
from tests.helpers import ts


def _frame(spark, n=3000, hot=True):
    rnd = random.Random(7)
    base = ts("2024-01-01 00:00:00")
    rows = []
    for i in range(n):
        # a third of the rows share one timestamp: a hot key in the order
        sec = 3600 if hot and i % 3 == 0 else rnd.randrange(0, 86400 * 5)
        val = f"v{i}" if rnd.random() < 0.05 else None
        rows.append((base.replace() + __import__("datetime").timedelta(seconds=sec), i, val))
    return spark.createDataFrame(rows, "t timestamp_ntz, seq long, v string")


def _check(df, got, expect_col, naive_expr):
    w = Window.orderBy("t", "seq")
    naive = df.withColumn("_want", naive_expr(w))
    j = got.join(naive.select("seq", "_want"), "seq")
    assert j.count() == df.count()
    assert j.filter(~F.col(expect_col).eqNullSafe(F.col("_want"))).count() == 0


def test_lead(spark):
    df = _frame(spark)
    _check(df, lead_in_order(df, ["t", "seq"], "seq", "nxt"), "nxt",
           lambda w: F.lead("seq").over(w))


def test_lag(spark):
    df = _frame(spark)
    _check(df, lag_in_order(df, ["t", "seq"], "seq", "prv", blocks=5), "prv",
           lambda w: F.lag("seq").over(w))


def test_carry_forward(spark):
    df = _frame(spark)
    _check(df, carry_forward(df, ["t", "seq"], "v", "cur", blocks=7), "cur",
           lambda w: F.last("v", ignorenulls=True).over(
               w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def test_hot_timestamp_is_split_over_blocks(spark):
    from scorewatch.operators.ordering import _blocks
    df = _frame(spark)
    sizes = [r["count"] for r in _blocks(df, ["t", "seq"], 8).groupBy("_block").count().collect()]
    assert max(sizes) < df.count() / 3      # the hot third does not land in one block


def test_tiny_inputs(spark):
    one = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 1, "a")],
                                "t timestamp_ntz, seq long, v string")
    assert lead_in_order(one, ["t", "seq"], "seq", "n").first()["n"] is None
    empty = one.filter("seq < 0")
    assert lag_in_order(empty, ["t", "seq"], "seq", "p").count() == 0


@pytest.mark.parametrize("blocks", [1, 7])
def test_within_keys_that_block_edges_cut(spark, blocks):
    rows = [(("a", "b", None, "hot")[3 if i % 3 else i % 4], i * 37 % 101 // 4, i, None if i % 5 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, seq int, v int")
    for name, ours, window in (
            ("lead", lead_in_order, "lead(v) OVER (PARTITION BY k ORDER BY t, seq)"),
            ("lag", lag_in_order, "lag(v) OVER (PARTITION BY k ORDER BY t, seq)"),
            ("carry", carry_forward, "last(v, true) OVER (PARTITION BY k ORDER BY t, seq)")):
        got = ours(df, ["t", "seq"], "v", "out", blocks=blocks, by=["k"]).select("seq", "out")
        assert sorted(got.collect()) == sorted(df.selectExpr("seq", f"{window} AS out").collect()), name
