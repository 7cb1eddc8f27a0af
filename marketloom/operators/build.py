"""The feature build in one call: from the raw daily table to every derived feature, in the long layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from . import features, screening, selection, timeseries as ts
from ..sources.panel import observations
from ..sources.tables import Tables


@dataclass(frozen=True)
class Build:
    """Settings. last: rows kept; late: days by which the test set shows the E and S columns late; burn: rows dropped once lags are made."""

    last: int = 5000
    late: int = 10
    burn: int = 62
    complete_only: bool = False
    drop_group_means: bool = False


def lag_source(raw: DataFrame, build: Build = Build()) -> DataFrame:
    """The last rows, with E and S columns shifted and the rows that they then lack cut."""
    return ts.shifted(ts.tail(raw, build.last), selection.matching([c for c in raw.columns if c != "row_id"], selection.LATE_BLOCK), build.late)


def build_features(raw: DataFrame, build: Build = Build()) -> DataFrame:
    """(row_id, feature, value) of raw (row_id, groups' columns, labels); row_id is dense from 0.

    The order is: last rows, late columns shifted, lags of the labels and their rolling features, the
    excess return, the burn, the first-valid filter, interactions, rolling features of what is left,
    means of literal groups dropped, components, gates. Rolling features start anew after the burn,
    lags before it. A missing column is skipped wherever it is asked for. complete_only leaves the rows
    in which every feature has a value. What several parts read is written once, as a table that cuts lineage.
    """
    tables = Tables(raw.sparkSession)
    data = tables.save(lag_source(raw, build), "shifted")
    labels = [c for c in selection.LABELS if c in data.columns]
    parts = [ts.skip(ts.lagged_block(data.select("row_id", *labels)), build.burn)] if labels else []
    if {"forward_returns", "risk_free_rate"} <= set(data.columns):
        data = data.withColumn(selection.TARGET, F.col("forward_returns") - F.col("risk_free_rate"))
    data = ts.skip(data, build.burn)
    known = [c for c in (*labels, selection.TARGET) if c in data.columns]
    parts += [observations(data, tuple(known))] if known else []

    candidates = selection.base_columns(data)
    obs = tables.save(screening.first_valid_filter(observations(data, tuple(candidates))), "kept")
    kept = [c for c in candidates if c in {r[0] for r in obs.select("feature").distinct().collect()}]
    crossed = features.interactions(data.select("row_id", *kept))
    if len(crossed.columns) > 1:
        parts.append(crossed.unpivot("row_id", [c for c in crossed.columns if c != "row_id"], "feature", "value"))
    block = ts.base_block(obs)
    block = tables.save(block.where(~F.col("feature").rlike(selection.literal_means(whole_group=build.drop_group_means))), "block")
    scores = tables.save(features.group_components(block), "scores")
    parts += [obs, block, scores, features.gate_block(block.unionByName(scores))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return complete_rows(out) if build.complete_only else out


def complete_rows(obs: DataFrame) -> DataFrame:
    """Rows in which every feature has a value."""
    short = obs.groupBy("row_id").agg(F.bool_or(F.col("value").isNull()).alias("short")).where("short").select("row_id")
    return obs.join(short, "row_id", "left_anti")


def without_empty(obs: DataFrame) -> DataFrame:
    """Features that have a value in some row."""
    return obs.join(obs.groupBy("feature").agg(F.count("value").alias("n")).where("n > 0").select("feature"), "feature", "left_semi")


def to_wide(obs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(row_id, a column a feature); names, or all features by name."""
    names = names or sorted(r[0] for r in obs.select("feature").distinct().collect())
    return obs.groupBy("row_id").pivot("feature", names).agg(F.first("value"))
