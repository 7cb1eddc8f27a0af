"""Lags, differences and rolling frames over the long layout (…, row_id, feature, value).

Column functions work over window partitions, a series each. Whole blocks of features are made in one pass, for
which a long series is cut into stretches. Frames are strict: NULL unless all their rows exist and hold a value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ranges, sliding
from ..functions.finance import clip

EPS_Z, EPS_POS = sliding.EPS_Z, sliding.EPS_POS
#: Windows by the exclusive prefix of a feature's name, and those of other names and of lagged labels.
WINDOWS = {"V": (5, 21, 63), "S": (5, 10, 21), "M": (5, 10, 21, 63), "MOM": (5, 21), "E": (63, 126, 252), "P": (63, 126, 252), "I": (21, 63)}
DEFAULT_WINDOWS = (21, 63)
#: The groups, MOM before M.
PREFIX = "^(MOM|E|S|V|M|P|I|D)"
LAG_WINDOWS, EXCESS_WINDOWS = (1, 2, 3, 5, 10, 21, 63), (1, 2, 3, 5, 10)


def series(by: tuple[str, ...] = ("feature",)):
    """The window of a series by row_id."""
    return Window.partitionBy(*by).orderBy("row_id")


def lagged(x: Column, k: int, by: tuple[str, ...] = ("feature",)) -> Column:
    """The value k rows before; NULL on the first k rows."""
    return F.lag(x, k).over(series(by))


def diff(x: Column, by: tuple[str, ...] = ("feature",)) -> Column:
    """The change since the row before; NULL if either is."""
    return x - lagged(x, 1, by)


def rolling(x: Column, w: int, by: tuple[str, ...] = ("feature",)) -> dict[str, Column]:
    """mean, std (sample), z and pos of the w rows up to each row. A frame of one value has z and pos 0, free of rounding."""
    frame = series(by).rowsBetween(-(w - 1), 0)
    full = F.count(x).over(frame) == w
    low, high = F.min(x).over(frame), F.max(x).over(frame)
    mean = F.when(low == high, x).otherwise(F.avg(x).over(frame))
    std = F.when(low == high, F.lit(0.0)).otherwise(F.stddev_samp(x).over(frame)) if w > 1 else F.lit(None).cast("double")
    out = {"mean": mean, "std": std, "z": (x - mean) / (std + EPS_Z), "pos": (x - low) / (high - low + EPS_POS)}
    return {k: F.when(full, v) for k, v in out.items()}


def rolling_long(obs: DataFrame, windows: tuple[int, ...], parts: tuple[str, ...], with_diff: bool = True, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by.., row_id, feature, value) with a row for each {feature}_{part}{w} and {feature}_d1; row_id is dense within a series."""
    return _rolled(obs, lambda feature: windows, parts, with_diff, max((1, *windows)), by)


def _rolled(obs: DataFrame, windows_of: Callable[[str], tuple[int, ...]], parts: tuple[str, ...], with_diff: bool, widest: int, by: tuple[str, ...]) -> DataFrame:
    def make(feature: str, x: np.ndarray) -> sliding.Made:
        out = [("_d1", sliding.difference(x))] * with_diff
        for w in windows_of(feature):
            got = sliding.frames(x, w)
            out += [(f"_{p}{w}", got[p]) for p in parts]
        return out

    return sliding.over_series(obs, by, widest, make)


def winsorized_frames(obs: DataFrame, w: int | None, q: float = 0.98, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by.., row_id, feature, value): values clipped to the quantiles of the w rows before each, or of all before it; what is missing becomes 0.

    A window's values are kept in order from row to row. Where all earlier rows count, a series is one task.
    """
    return sliding.over_series(obs, by, w, lambda feature, x: [("", sliding.winsorized(x, w, q))])


def prefix_of(feature: Column) -> Column:
    """MOM before M; DEFAULT for names of no group."""
    got = F.regexp_extract(feature, PREFIX, 1)
    return F.when(got == "", "DEFAULT").otherwise(got)


def base_block(obs: DataFrame, by: str | None = None) -> DataFrame:
    """Mean, z and pos over the windows of each feature's group, and its difference; of each entity where `by` names one."""

    def windows_of(feature: str | None) -> tuple[int, ...]:
        group = re.match(PREFIX, feature or "")
        return WINDOWS.get(group[0] if group else "", DEFAULT_WINDOWS)

    return _rolled(obs, windows_of, ("mean", "z", "pos"), True, max(max(w) for w in (*WINDOWS.values(), DEFAULT_WINDOWS)), _keys(by))


def _keys(by: str | None) -> tuple[str, ...]:
    return (by, "feature") if by else ("feature",)


def lagged_block(labels: DataFrame, by: str | None = None) -> DataFrame:
    """Of labels (row_id, three labels) the lags by one row, their difference, and rolling features of them; a missing label is skipped.

    Lags are taken series by series, with their features. row_id is dense within a series.
    """
    ids = ([by] if by else []) + ["row_id"]
    names = [c for c in labels.columns if c not in ids]
    wide = labels.select(*ids, *(F.col(c).cast("double").alias(f"lagged_{c}") for c in names))
    if {"lagged_forward_returns", "lagged_risk_free_rate"} <= set(wide.columns):
        wide = wide.withColumn("lagged_excess", F.col("lagged_forward_returns") - F.col("lagged_risk_free_rate"))
    long = wide.unpivot(ids, [c for c in wide.columns if c not in ids], "feature", "value")

    def make(feature: str, x: np.ndarray) -> sliding.Made:
        x = np.concatenate([[np.nan], x[:-1]])[: len(x)]
        out = [("", x), ("_d1", sliding.difference(x))]
        for w in EXCESS_WINDOWS if feature == "lagged_excess" else LAG_WINDOWS:
            got = sliding.frames(x, w)
            out += [(f"_{p}{w}", got[p]) for p in ("mean", "std", "z")]
        return out

    return sliding.over_series(long, _keys(by), max(LAG_WINDOWS) + 1, make)


def score_zscore(x: Column, w: int, by: tuple[str, ...] = ("feature",)) -> Column:
    """Over the values that a frame has; NULL without spread, no epsilon."""
    frame = series(by).rowsBetween(-(w - 1), 0)
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    return F.when(~flat, (x - F.avg(x).over(frame)) / F.stddev_samp(x).over(frame))


def availability(x: Column, w: int = 63, least: int = 21, by: tuple[str, ...] = ("feature",)) -> Column:
    """1 where the last w rows, as far as they exist, hold at least `least` values, else 0."""
    return (F.count(x).over(series(by).rowsBetween(-(w - 1), 0)) >= least).cast("int")


def winsor_bounds(x: Column, w: int | None, q: float = 0.98, by: tuple[str, ...] = ("feature",)) -> Column:
    """[low, high] quantiles of the w rows before each row, or of all before it; interpolated, without NULLs."""
    start = Window.unboundedPreceding if w is None else -w
    return F.percentile(x, F.array(F.lit(1 - q), F.lit(q))).over(series(by).rowsBetween(start, -1))


def winsorized(x: Column, bounds: Column) -> Column:
    """Clipped to the bounds; what is missing becomes 0 afterwards."""
    low, high = F.get(bounds, 0), F.get(bounds, 1)
    return F.coalesce(F.when(x < low, low).when(x > high, high).otherwise(x), F.lit(0.0))


def filled(x: Column, backward: bool = False, by: tuple[str, ...] = ("feature",)) -> Column:
    """The last value so far; with `backward`, which looks ahead, leading gaps take the first value."""
    ahead = F.last(x, ignorenulls=True).over(series(by).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(ahead, F.first(x, ignorenulls=True).over(series(by).rowsBetween(0, Window.unboundedFollowing))) if backward else ahead


def in_order(by: str):
    """The window of an entity's rows by row_id."""
    return Window.partitionBy(by).orderBy("row_id")


def tail(df: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The last n rows, of each entity where `by` names one, renumbered from 0; without `by` row_id is dense from 0."""
    if by:
        back = Window.partitionBy(by).orderBy(F.desc("row_id"))
        return renumbered(df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back"), by)
    return skip(df, max(0, df.count() - n))


def renumbered(df: DataFrame, by: str | None = None) -> DataFrame:
    """row_id from 0 in its order, without gaps."""
    if by is None:
        return ranges.numbered(df.withColumnRenamed("row_id", "_old"), "_old").select(*df.columns)
    return df.withColumn("row_id", (F.row_number().over(in_order(by)) - 1).cast("long"))


def skip(df: DataFrame, n: int) -> DataFrame:
    """Without the first n rows, renumbered from 0; row_id must be dense."""
    return df.where(F.col("row_id") >= n).withColumn("row_id", F.col("row_id") - n)


def shifted(df: DataFrame, columns: list[str], k: int = 10, by: str | None = None) -> DataFrame:
    """columns take their values of k rows before; the first k rows go. Without columns nothing changes."""
    if not columns:
        return df
    names = df.columns
    own = ranges.moved(df, {c: c for c in columns}, k) if by is None else df.withColumns({c: F.lag(c, k).over(in_order(by)) for c in columns})
    return skip(own.select(*names), k)


def gate(s: Column, alpha: float, high: float) -> Column:
    """1 and alpha times the score within [0, high]; 1 where it is missing."""
    return 1 + alpha * clip(F.coalesce(s, F.lit(0.0)), 0, high)
