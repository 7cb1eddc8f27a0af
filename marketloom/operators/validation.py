"""Folds in time, scaling, and a line of one feature from running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def rolling_folds(spark: SparkSession, n: int, train: int = 752, val: int = 21, step: int = 21, embargo: int = 0, most: int | None = None) -> DataFrame:
    """(fold, tr_start, tr_end, va_start, va_end), ends exclusive; whole validation windows only, the first `most` of them."""
    folds = max(0, (n - train - val) // step + 1)
    f = spark.range(folds if most is None else min(folds, most)).select(F.col("id").alias("fold"), (F.lit(train) + F.col("id") * step).alias("va_start"))
    f = f.withColumn("tr_end", F.greatest(F.col("va_start") - embargo, F.lit(0)))
    return f.select("fold", F.greatest(F.col("tr_end") - train, F.lit(0)).cast("long").alias("tr_start"), F.col("tr_end").cast("long").alias("tr_end"), F.col("va_start").cast("long").alias("va_start"), (F.col("va_start") + val).cast("long").alias("va_end")).where("tr_start < tr_end")


def expanding_folds(spark: SparkSession, n: int, splits: int = 5) -> DataFrame:
    """(fold, tr_start, tr_end, va_start, va_end): the last `splits` blocks of n // (splits + 1) rows, each after all rows before it."""
    size = n // (splits + 1)
    first = n - splits * size
    return spark.range(splits).select(F.col("id").alias("fold"), F.lit(0).cast("long").alias("tr_start"), (first + F.col("id") * size).alias("tr_end"), (first + F.col("id") * size).alias("va_start"), (first + (F.col("id") + 1) * size).alias("va_end"))


def holdout(df: DataFrame, n: int, last: int = 180) -> DataFrame:
    """Adds part (core or hold) and place, the row's number within it. row_id is dense from 0."""
    core = F.col("row_id") < n - last
    return df.withColumn("part", F.when(core, "core").otherwise("hold")).withColumn("place", F.when(core, F.col("row_id")).otherwise(F.col("row_id") - max(0, n - last)))


def standard_scale(obs: DataFrame, core_end: int) -> DataFrame:
    """Values less the mean over the population's deviation, both of rows before core_end; no deviation counts as 1."""
    fit = obs.where(F.col("row_id") < core_end).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), (F.min("value") == F.max("value")).alias("flat"))
    return obs.join(fit, "feature").select("row_id", "feature", ((F.col("value") - F.when(F.col("flat"), F.col("value") * 0 + F.col("m")).otherwise(F.col("m"))) / F.when(F.col("flat"), 1.0).otherwise(F.col("s"))).alias("value"))


def fold_mse_ratio(pred: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, ratio, recent): squared error over that of predicting 0 (1 where that is 0), and its mean over the last ten folds.

    pred is (row_id, y, yhat); a fold's rows come from its sequence of row ids, an equi-join.
    """
    rows = folds.select("fold", F.explode(F.sequence("va_start", F.col("va_end") - 1)).alias("row_id"))
    e = rows.join(pred, "row_id").groupBy("fold").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"), F.avg(F.pow("y", F.lit(2))).alias("zero"))
    ratio = F.when(F.col("zero") > 0, F.col("mse") / F.col("zero")).otherwise(1.0)
    return e.select("fold", ratio.alias("ratio")).withColumn("recent", F.avg("ratio").over(Window.orderBy("fold").rowsBetween(-9, 0)))


def linear_walk_forward(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """([by,] row_id, yhat): a line fitted on all earlier rows, from running sums; NULL until two differing values of x."""
    ids = [by] if by else []
    past = Window.partitionBy(*ids).orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(known, F.col(x)), F.when(known, F.col(y))
    slope, at = F.regr_slope(b, a).over(past), F.regr_intercept(b, a).over(past)
    return df.select(*ids, "row_id", (slope * F.col(x) + at).alias("yhat"))
