"""Interactions, gates and the causal principal component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import expanding, selection, timeseries as ts
from ..functions.finance import clip
from ..sources.tables import Tables

#: The pairs that interact, and how.
INTERACTIONS = (("I2", "I1", "diff"), ("I7", "I1", "diff"), ("P1", "E1", "ratio"), ("V1", "M1", "ratio"), ("S1", "S2", "diff"))
EPS = 1e-6
#: Each group's component, as (window, None for all rows before; rows that must come first; window of its z-score).
COMPONENTS = {"V": (126, 126, 126), "M": (126, 126, 126), "MOM": (63, 63, 126), "E": (252, 252, 252), "S": (126, 126, 252), "I": (None, 504, 252), "P": (None, 504, 252)}
#: The z-scores that gates act on, by group.
GATED = {"V": (21, 63), "S": (21, 63), "M": (21, 63), "MOM": (21, 63), "E": (126, 252), "P": (126, 252), "I": (63, 126)}
#: Gates, as (name, the score that opens it, its weight, its limit, groups that it acts on).
GATES = (("E", "E_pc1_z252", 0.5, 3.0, ("V",)), ("V", "V_pc1_z126", 0.5, 3.0, ("S", "M", "MOM", "E", "P", "I")), ("Vstrong", "V_pc1_z126", 0.8, 4.0, ("S",)))
#: Days that are scored together.
DAYS = 128


def interactions(wide: DataFrame, pairs: tuple = INTERACTIONS, eps: float = EPS, flags: bool = False, prefix: str = "XINT_") -> DataFrame:
    """(row_id, a column a pair); pairs with a missing column, or of an unknown kind, are skipped.

    A ratio is NULL where its denominator is within eps of 0. With flags, _miss tells where either side
    is NULL, and _denom_small where a ratio's denominator is there and within eps of 0.
    """
    cols = []
    for a, b, op in pairs:
        if a not in wide.columns or b not in wide.columns or op not in ("diff", "ratio"):
            continue
        x, y, name = F.col(a), F.col(b), f"{prefix}{a}_{b}_{op}"
        cols.append((x - y if op == "diff" else F.when(F.abs(y) > eps, x / y)).alias(name))
        if flags and op == "ratio":
            cols.append(F.coalesce(F.abs(y) <= eps, F.lit(False)).cast("int").alias(f"{name}_denom_small"))
        if flags:
            cols.append((x.isNull() | y.isNull()).cast("int").alias(f"{name}_miss"))
    return wide.select("row_id", *cols)


def gated(obs: DataFrame, gates: DataFrame, name: str, missing_term: bool = False, mask: bool = False, least: int = 21, window: int = 63) -> DataFrame:
    """(row_id, feature_g{name}, value): missing values count as 0, missing gates as 1. gates (row_id, g) has a row a day.

    With mask, rows with fewer than `least` values in the last `window` rows are 0, and _unavail marks
    them. With missing_term, _miss is the gate where the value is missing, else 0.
    """
    g, seen = F.coalesce("g", F.lit(1.0)), ts.availability(F.col("value"), window, least) if mask else F.lit(1)
    x = obs.withColumn("seen", seen).join(gates, "row_id", "left")
    parts = [("", F.coalesce("value", F.lit(0.0)) * g * F.col("seen"))]
    if mask:
        parts.append(("_unavail", (1 - F.col("seen")).cast("double")))
    if missing_term:
        parts.append(("_miss", F.when(F.col("value").isNull(), g).otherwise(0.0)))
    each = F.explode(F.array(*(F.struct(F.lit(f"_g{name}{s}").alias("s"), v.alias("v")) for s, v in parts))).alias("p")
    return x.select("row_id", "feature", each).select("row_id", F.concat("feature", "p.s").alias("feature"), F.col("p.v").alias("value"))


def first_component(train: np.ndarray, x: np.ndarray, q: float, least: int) -> float:
    """x's score on the first component of train; both clipped to train's quantiles, what is missing then 0. NaN with too few columns."""
    active = ~np.isnan(train).all(axis=0)
    if active.sum() < least:
        return float("nan")
    train, x = train[:, active], x[active]
    low, high = (np.nanquantile if np.isnan(train).any() else np.quantile)(train, [1 - q, q], axis=0)
    train, x = (np.nan_to_num(np.clip(v, low, high)) for v in (train, x))
    mean = train.mean(axis=0)
    return float((x - mean) @ expanding.leading((train - mean).T @ (train - mean)))


def causal_pc1(wide: DataFrame, columns: list[str], window: int | None, warmup: int, q: float = 0.98, least: int = 5, by: str | None = None) -> DataFrame:
    """(entity, row_id, pc1): each row's score on a component fitted on earlier rows alone; row_id is dense from 0.

    The window is the rows before, all of them where it is None. The component's largest loading is
    positive, of equal ones the first. DAYS rows of an entity are scored together, and the rows of their windows are dealt to
    them, or of all rows before sums of products; without `by` there is one entity.
    """
    entity = F.col(by).cast("string") if by else F.lit("all")
    if window is None:
        out = expanding.expanding_pc1(wide.select(entity.alias("entity"), "row_id", *columns), columns, warmup, q, least, DAYS)
        return out.withColumn("pc1", F.nanvl("pc1", F.lit(None).cast("double")))
    first = max(warmup, window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        m, at = pdf[columns].to_numpy(dtype=float), pdf["row_id"].to_numpy()
        own = np.flatnonzero(at // DAYS == pdf["part"].iloc[0])
        got = [first_component(m[t - window : t], m[t], q, least) if at[t] >= first else np.nan for t in own]
        return pd.DataFrame({"entity": pdf["entity"].iloc[own], "row_id": at[own], "pc1": got})

    ends = wide.groupBy(entity.alias("entity")).agg(F.floor(F.max("row_id") / DAYS).alias("_top"))
    last = F.least("_top", F.floor((F.col("row_id") + window) / DAYS))
    dealt = wide.select(entity.alias("entity"), "row_id", *columns).join(ends, "entity").withColumn("part", F.explode(F.sequence(F.floor(F.col("row_id") / DAYS), last))).drop("_top")
    # The number of tasks is stated, as small tables of costly days would be put together in one.
    dealt = dealt.repartition(2 * wide.sparkSession.sparkContext.defaultParallelism, "entity", "part")
    out = dealt.groupBy("entity", "part").applyInPandas(run, "entity string, row_id long, pc1 double")
    return out.withColumn("pc1", F.nanvl("pc1", F.lit(None).cast("double")))


def group_components(obs: DataFrame, plan: dict = COMPONENTS, window: int = 21) -> DataFrame:
    """(row_id, feature, value): of each group's z-scores of `window` rows the component, its z-score and the positive part of that.

    A group without such columns has no component; one with too few values at a time has NULLs.
    """
    obs = Tables(obs.sparkSession).save(obs.where(F.col("feature").endswith(f"_z{window}")).select("row_id", "feature", "value"), "scores")  # read once a group
    names = [r[0] for r in obs.select("feature").distinct().collect()]
    out = obs.where("false").select("row_id", "feature", "value")
    for group, (frame, warmup, zwin) in plan.items():
        own = sorted(selection.matching(names, selection.group_members(group, window)))
        if not own:
            continue
        wide = obs.where(F.col("feature").isin(own)).groupBy("row_id").pivot("feature", own).agg(F.first("value"))
        score = causal_pc1(wide, own, frame, warmup).select("row_id", F.lit(f"{group}_pc1").alias("feature"), F.col("pc1").alias("value"))
        z = ts.score_zscore(F.col("value"), zwin)
        made = F.array(*(F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in ((f"{group}_pc1", F.col("value")), (f"{group}_pc1_z{zwin}", F.col("z")), (f"{group}_pc1_pos", clip(F.col("z"), 0, None)))))
        out = out.union(score.withColumn("z", z).select("row_id", F.explode(made).alias("p")).select("row_id", "p.n", "p.v"))
    return out


def gate_block(obs: DataFrame, gates: tuple = GATES, plan: dict = GATED) -> DataFrame:
    """(row_id, feature, value) of every gate whose score obs has, over the z-scores that the plan names; each once, though prefixes overlap."""
    names = {r[0] for r in obs.where(F.col("feature").isin([g[1] for g in gates])).select("feature").distinct().collect()}
    out = obs.where("false").select("row_id", "feature", "value")
    for name, score, alpha, high, groups in gates:
        if score in names:
            g = obs.where(F.col("feature") == score).select("row_id", ts.gate(F.col("value"), alpha, high).alias("g"))
            out = out.union(gated(obs.where(F.col("feature").rlike(selection.z_scores({p: plan[p] for p in groups}))), g, name))
    return out
