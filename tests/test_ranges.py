"""Series over many ranges against the whole series in one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import finance
from marketloom.operators import ranges, timeseries as ts
from marketloom.plans import catalogue


@pytest.fixture
def many(spark):
    """So that ranges stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def series(spark, n, gaps=0.2):
    rng = np.random.default_rng(n)
    x = 0.05 * rng.normal(size=n)
    x[rng.random(n) < gaps] = np.nan
    x[:3] = np.nan
    rows = [(3 * i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    np.random.default_rng(1).shuffle(rows)
    return pd.Series(x), spark.createDataFrame([(int(a), b) for a, b in rows], "row_id long, ret double")


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_running_sums_changes_and_numbers(spark, many, n):
    x, df = series(spark, n)
    got = finance.drawdown(df).orderBy("row_id").toPandas()
    curve = np.exp(np.log1p(x).cumsum().ffill())
    np.testing.assert_allclose(got.curve.astype(float), curve)
    np.testing.assert_allclose(got.drawdown.astype(float), curve / curve.cummax() - 1, atol=1e-12)
    turn = finance.turnover(df, "ret").orderBy("row_id").toPandas().turnover
    np.testing.assert_allclose(turn.astype(float), x.diff().abs())
    again = ts.renumbered(df).orderBy("row_id").toPandas()
    assert again.row_id.tolist() == list(range(n)) and again.columns.tolist() == ["row_id", "ret"]
    np.testing.assert_allclose(again.ret.astype(float), x)
    if n > 100:
        assert ranges.in_ranges(df, "row_id").select("_range").distinct().count() > 4


def test_rows_before_and_after(spark, many):
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"))
    for k in (1, 10, -3):
        got = ranges.moved(df, {"a": "a", "c": "b"}, k).orderBy("row_id").collect()
        assert [(r.a, r.c) for r in got] == [(2 * (i - k), "x") if 0 <= i - k < 50 else (None, None) for i in range(50)]
    assert [r.a for r in ts.shifted(df, ["a"], 10).orderBy("row_id").collect()] == [2 * i for i in range(40)]
    assert ts.tail(df, 7).agg(F.min("row_id"), F.max("row_id"), F.min("a")).first()[:] == (0, 6, 86)
    assert ts.tail(df, 70).count() == 50


@pytest.mark.parametrize("name", ["lagged_block", "rolling_base_block", "drawdown", "turnover", "position_rule", "shift_block", "tail_and_burn", "daily_panel", "winsorized"])
def test_no_task_sees_the_whole_series(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
