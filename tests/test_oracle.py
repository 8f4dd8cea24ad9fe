"""Each registered query equals its DuckDB oracle (the driver's correctness gate)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.helpers import rows_of

# Keys whose Spark side writes files or runs streams are covered too; the
# slow fitted-model keys have no oracle.
KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[key]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_contract_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["window_day", "accurate_prediction", "count", "total", "ratio"]
    assert df.count() > 0
