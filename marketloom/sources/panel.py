"""The daily panel: one row a ship day, from line items and orders.

Measures come from exact integers (cents, hundredths), so that any order of summation gives the same
doubles. Days are pre-aggregated, and numbered by ranges of days, which are saved: later reads start from one row a day.
Line items without a ship date make up a day of their own, the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import ranges

#: The columns of each group, by the first letters of their names.
FEATURES = (
    "M1", "M2", "M3", "M4", "M5", "V1", "V2", "V3", "V4", "V5", "S1", "S2", "S3", "S4", "S5",
    "I1", "I2", "I3", "I4", "I7", "P1", "E1", "E2", "MOM1", "D1", "D2",
)
LABELS = ("forward_returns", "risk_free_rate", "market_forward_excess_returns")


def _std(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n > 1, F.sqrt((n * squares - total * total).cast("double") / (n * (n - 1)).cast("double")))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id from 0, FEATURES, LABELS), all but row_id doubles."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.to_date("l_shipdate").alias("day"), cents.alias("c"), F.round(F.col("l_extendedprice")).cast("long").alias("p"), F.round("l_quantity").cast("long").alias("q"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.round(F.col("l_tax") * 100).cast("long").alias("t"), "l_returnflag", "l_linestatus",
    )
    n = F.count("*")
    share = lambda c, v: (F.sum(F.when(F.col(c) == v, 1).otherwise(0)) / n).cast("double")
    top = lambda c: F.max(c) - F.min(c)
    days = lines.groupBy("day").agg(
        (F.sum("c") / n / 100.0).alias("M1"), (F.sum("q") / n).alias("M2"), n.cast("double").alias("M3"), (F.max("c") / 100.0).alias("M4"), (F.min("c") / 100.0).alias("M5"),
        _std(n, F.sum("q"), F.sum(F.col("q") * F.col("q"))).alias("V1"), _std(n, F.sum("d"), F.sum(F.col("d") * F.col("d"))).alias("V2"),
        top("p").cast("double").alias("V3"), top("q").cast("double").alias("V4"), top("d").cast("double").alias("V5"),
        share("l_returnflag", "R").alias("S1"), share("l_returnflag", "A").alias("S2"), share("l_returnflag", "N").alias("S3"), share("l_linestatus", "O").alias("S4"), share("l_linestatus", "F").alias("S5"),
        (F.sum("d") / n / 100.0).alias("I1"), (F.sum("t") / n / 100.0).alias("I2"), ((F.sum("d") + F.sum("t")) / n / 100.0).alias("I3"), (F.max("d") / 100.0).alias("I4"), (F.max("t") / 100.0).alias("I7"),
        (F.sum("c") / F.sum("q") / 100.0).alias("P1"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 100.0).alias("E1"), F.count("*").cast("double").alias("E2")
    )
    own = ranges.numbered(days.join(orders, "day", "left").withColumn("undated", F.col("day").isNull()), "undated", "day")
    m1 = own.select("row_id", "M1")
    own = own.join(m1.select((F.col("row_id") + 1).alias("row_id"), F.col("M1").alias("_back")), "row_id", "left").join(m1.select((F.col("row_id") - 1).alias("row_id"), F.col("M1").alias("_ahead")), "row_id", "left")
    fr = 0.01 * (F.col("_ahead") / F.col("M1") - 1)
    return own.select(
        "row_id", *FEATURES[:23], (F.col("M1") - F.col("_back")).alias("MOM1"),
        (F.weekday("day") + 1).cast("double").alias("D1"), F.month("day").cast("double").alias("D2"),
        fr.alias("forward_returns"), (F.col("I2") / 252).alias("risk_free_rate"), (fr - F.col("I2") / 252).alias("market_forward_excess_returns"),
    )


def observations(panel: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """The long layout (row_id, feature, value), NULL for what is missing or not finite."""
    clean = panel.select("row_id", *(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in columns))
    return clean.unpivot("row_id", list(columns), "feature", "value")
