"""Positions, returns and risk as column expressions and single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import ranges


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """NULL stays NULL, which greatest and least would skip."""
    out = F
    if low is not None:
        out = out.when(x < low, F.lit(float(low)))
    if high is not None:
        out = out.when(x > high, F.lit(float(high)))
    return x if out is F else out.otherwise(x)


def finite(x: Column) -> Column:
    """Neither NULL nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def position_rule(pred: Column, vol: Column, mom: Column, k: float = 6.0, floor: float = 1e-4, mom_floor: float = -0.0005, high: float = 2.0) -> Column:
    """1 + tanh(k pred / vol) within [0, high]; no more than 1 while momentum is below its floor."""
    safe = F.when(~finite(vol) | (vol < floor), F.lit(floor)).otherwise(vol)
    raw = 1 + F.tanh(k * pred / safe)
    return clip(F.when(finite(mom) & (mom < mom_floor) & (raw > 1), F.lit(1.0)).otherwise(raw), 0, high)


def to_position(yhat: Column, mode: str, k: float = 6.0) -> Column:
    """A position within [0, 2]: the value itself, 1 + tanh(k yhat) of an excess return, or twice a probability."""
    if mode == "position":
        return clip(yhat, 0, 2)
    if mode == "excess":
        return clip(1 + F.tanh(k * yhat), 0, 2)
    if mode == "prob":
        return clip(2 * yhat, 0, 2)
    raise ValueError(f"unknown mode {mode!r}: position, excess or prob")


def strategy_returns(df: DataFrame, position: str = "position") -> DataFrame:
    """Adds ret, the strategy's return, and ex and mex, its and the market's over the risk-free rate."""
    p, rf, fr = F.col(position), F.col("risk_free_rate"), F.col("forward_returns")
    return df.withColumn("ret", rf * (1 - p) + p * fr).withColumn("ex", F.col("ret") - rf).withColumn("mex", fr - rf)


def adjusted_sharpe(df: DataFrame, position: str = "position", days: int = 252, mode: str = "position", k: float = 2.0) -> DataFrame:
    """One row: the Sharpe ratio with its penalties for volatility over 1.2 of the market's and for falling behind it.

    mode tells what the position column holds, as in to_position. Standard deviations are of the
    population; volatilities are a year's, in hundredths. A table without rows, and a strategy or market
    without variance, scores 0.
    """
    n, year = F.count("*"), float(days) ** 0.5
    r = strategy_returns(df.withColumn(position, to_position(F.col(position), mode, k)), position).agg(
        n.alias("n"), F.product(1 + F.col("ex")).alias("se"), F.product(1 + F.col("mex")).alias("me"), F.stddev_pop("ret").alias("sd"), F.stddev_pop("forward_returns").alias("md")
    )
    each = F.try_divide(F.lit(1.0), F.col("n"))
    r = r.select("n", "sd", "md", (F.pow("se", each) - 1).alias("strat_mean_excess"), (F.pow("me", each) - 1).alias("mkt_mean_excess"))
    r = r.withColumn("sharpe", F.when(F.col("sd") > 0, F.col("strat_mean_excess") / F.col("sd") * year).otherwise(0.0))
    r = r.withColumn("strategy_vol_annual", F.col("sd") * year * 100).withColumn("market_vol_annual", F.col("md") * year * 100)
    r = r.withColumn("vol_penalty", 1 + clip(F.when(F.col("md") > 0, F.col("sd") / F.col("md")).otherwise(0.0) - 1.2, 0, None))
    r = r.withColumn("return_penalty", 1 + F.pow(clip((F.col("mkt_mean_excess") - F.col("strat_mean_excess")) * 100 * days, 0, None), 2) / 100)
    score = F.least(F.col("sharpe") / (F.col("vol_penalty") * F.col("return_penalty")), F.lit(1e6))
    none = (F.col("n") == 0) | (F.col("sd") == 0) | (F.col("md") == 0)
    parts = ("sharpe", "strategy_vol_annual", "market_vol_annual", "vol_penalty", "return_penalty", "strat_mean_excess", "mkt_mean_excess")
    return r.select(F.col("n").alias("n_days"), *parts, F.when(none, 0.0).otherwise(score).alias("adjusted_sharpe"))


def in_order(by: str):
    """The window of an entity's rows by row_id."""
    return Window.partitionBy(by).orderBy("row_id")


def drawdown(df: DataFrame, ret: str = "ret", by: str | None = None) -> DataFrame:
    """Adds curve, the cumulative return, and drawdown from its running top; of each entity where `by` names one."""
    if by is None:
        out = ranges.running(df.withColumn("_log", F.log1p(ret)), "_log")
        return out.select(*df.columns, F.exp("total").alias("curve"), (F.exp(F.col("total") - F.col("top")) - 1).alias("drawdown"))
    upto = in_order(by).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("curve", F.exp(F.sum(F.log1p(ret)).over(upto)))
    return out.withColumn("drawdown", F.col("curve") / F.max("curve").over(upto) - 1)


def turnover(df: DataFrame, position: str = "position", by: str | None = None) -> DataFrame:
    """Adds turnover, the absolute change of the position since the row before; NULL on the first row."""
    if by is None:
        return ranges.change(df, position, "turnover").withColumn("turnover", F.abs("turnover"))
    return df.withColumn("turnover", F.abs(F.col(position) - F.lag(position, 1).over(in_order(by))))


def distribution(df: DataFrame, ret: str = "ret", width: float = 0.0005) -> DataFrame:
    """(low, n): how many returns lie in each step of `width` from low on; without NULLs."""
    step = F.floor(F.col(ret) / width)
    return df.where(F.col(ret).isNotNull()).groupBy(step.alias("step")).agg(F.count("*").alias("n")).select((F.col("step") * width).alias("low"), "n")
