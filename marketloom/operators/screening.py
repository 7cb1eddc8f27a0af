"""Profiles of missing values, screening of features and cuts by importance, over the long layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .selection import is_excluded
from ..sources.tables import Tables

#: Loose prefixes; MOM1 starts with M as well as with MOM.
PREFIXES = ("E", "S", "V", "M", "MOM", "P", "I", "D")
#: Values that a task compares at once, features of a block at most.
VALUES, BLOCK = 1 << 24, 64
#: Bounds that importances are counted by.
BOUNDS = (300, 250, 200, 100, 80, 50)


def first_valid_profile(obs: DataFrame, quantile: float = 0.9, share: float = 0.25) -> DataFrame:
    """(prefix, feature, first_valid, cut, late): when each feature starts, against its group.

    A feature is late after its group's interpolated quantile, cut to an integer, after that share of
    all rows, or without any value.
    """
    first = obs.where(~is_excluded(F.col("feature"))).groupBy("feature").agg(F.min(F.when(F.col("value").isNotNull(), F.col("row_id"))).alias("first_valid"), F.count("*").alias("n"))
    groups = first.withColumn("prefix", F.explode(F.array(*map(F.lit, PREFIXES)))).where(F.col("feature").startswith(F.col("prefix")))
    cut = F.floor(F.percentile("first_valid", quantile).over(Window.partitionBy("prefix")))
    out = groups.withColumn("cut", cut)
    late = F.col("first_valid").isNull() | (F.col("first_valid") > F.col("cut")) | (F.col("first_valid") > F.floor(F.col("n") * share))
    return out.select("prefix", "feature", "first_valid", "cut", late.alias("late"))


def prefix_counts(profile: DataFrame) -> DataFrame:
    """(prefix, n): features of each loose prefix in a first-valid profile."""
    return profile.groupBy("prefix").agg(F.count("*").alias("n"))


def first_valid_filter(obs: DataFrame) -> DataFrame:
    """Without features that are late in any of their groups; ids, labels and lags stay."""
    late = first_valid_profile(obs).where("late").select("feature").distinct()
    return obs.join(late, "feature", "left_anti")


def missing_profile(obs: DataFrame) -> DataFrame:
    """(feature, n_rows, n_valid, missing, std): counts, the share that is NULL, and the sample's deviation."""
    return obs.groupBy("feature").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_valid"), F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.stddev_samp("value").alias("std"))


def _ranked(value: str, by: tuple[str, ...]) -> F.Column:
    """Ranks from 1; ties share the mean of theirs."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> F.Column:
    """An aggregate: the correlation over rows in which both have values, NULL where either is constant. corr itself fails on a constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def _patterns(x: DataFrame) -> DataFrame:
    """(feature, pattern): features with values in the same rows have the same pattern."""
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")), F.sum(F.xxhash64("row_id", F.lit(7)).cast("decimal(38,0)")))
    return x.groupBy("feature").agg(F.xxhash64(mark).alias("pattern"))


def _gram(x: DataFrame) -> DataFrame:
    """(lo, hi, a, b, dot) for a <= b, of x (lo, hi, row_id, feature, own, r): sums of products of r over the rows that a pair of patterns shares.

    A row's values meet once; a task adds up their products and gives a number a pair of features. Of
    features with the same pattern only those that lie in the pair (own, own) count, and squares.
    """
    rows = x.groupBy("lo", "hi", "row_id").agg(F.array_sort(F.collect_list(F.struct("feature", "own", "r"))).alias("v"))
    rows = rows.select("lo", "hi", F.col("v.feature").alias("names"), F.col("v.own").alias("own"), F.col("v.r").alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["lo", "hi"]):
                m = np.stack(part["r"].to_numpy())
                names, own, total = sums.get(key, (list(part["names"].iloc[0]), np.asarray(part["own"].iloc[0]), 0))
                sums[key] = names, own, total + m.T @ m
        for (lo, hi), (names, own, total) in sums.items():
            i, j = np.triu_indices(len(names))
            kept = (i == j) | (own[i] != own[j]) | (lo == hi)
            i, j, names = i[kept], j[kept], np.array(names, dtype=object)
            yield pd.DataFrame({"lo": lo, "hi": hi, "a": names[i], "b": names[j], "dot": total[i, j]})

    return rows.mapInPandas(run, "lo long, hi long, a string, b string, dot double").groupBy("lo", "hi", "a", "b").agg(F.sum("dot").alias("dot"))


def correlations(obs: DataFrame, method: str = "spearman", values: int = VALUES) -> DataFrame:
    """(a, b, rho) for a < b over the rows in which both have values, by ranks or (method pearson) by values; NULL where either is constant there, no row where they share none.

    Features are dealt in blocks, and a task gets two blocks, of `values` values in all at most: so that a
    table of any width is as many bounded tasks as there are pairs of blocks. Where even two features are more
    than that, their rows are spread over tasks instead.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}: spearman or pearson")
    x = obs.where("value IS NOT NULL").select("row_id", "feature", "value")
    sizes = {r.feature: r.n for r in x.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # a number a column
    longest = max(sizes.values(), default=0)
    if 2 * longest > values:
        return _correlations_by_rows(obs, method)
    width = max(1, min(BLOCK, values // (2 * max(1, longest))))
    return _correlations_by_blocks(x, sorted(sizes, key=str.encode), method, width)


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share the mean of theirs."""
    _, at, many = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(many) - (many - 1) / 2)[at]


def _standard(m: np.ndarray, method: str) -> np.ndarray:
    """Rows at mean 0 and length 1, by ranks or values; NaN where a row is constant."""
    flat = m.min(axis=1) == m.max(axis=1)
    r = np.array([_ranks(v) for v in m]) if method == "spearman" else m
    off = r - r.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = off / np.sqrt((off * off).sum(axis=1, keepdims=True))
    out[flat] = np.nan
    return out


def _block_pair(pdf: pd.DataFrame, method: str) -> pd.DataFrame:
    """(a, b, rho) of the pairs between two blocks, or within one. Features with values in the same rows are ranked together, once for each set of rows that they are asked about."""
    pdf = pdf.sort_values("at").reset_index(drop=True)
    ids = np.unique(np.concatenate(pdf["ids"].to_list()))
    m = np.full((len(pdf), len(ids)), np.nan)
    for i, (own, v) in enumerate(zip(pdf["ids"], pdf["vs"])):
        m[i, np.searchsorted(ids, own)] = v
    there = ~np.isnan(m)
    _, kind = np.unique(np.packbits(there, axis=1), axis=0, return_inverse=True)
    side, within = pdf["block"].to_numpy(), pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    left, right = (np.flatnonzero(side == pdf[k].iloc[0]) for k in ("lo", "hi"))
    names, out = pdf["feature"].to_numpy(), []
    for p in np.unique(kind[left]):
        for q in np.unique(kind[right]):
            a, b = left[kind[left] == p], right[kind[right] == q]
            both = there[a[0]] & there[b[0]]
            if not both.any():
                continue
            rho = _standard(m[a][:, both], method) @ _standard(m[b][:, both], method).T
            i, j = np.nonzero(a[:, None] < b[None, :]) if within else (g.ravel() for g in np.indices(rho.shape))
            out.append(pd.DataFrame({"a": names[a[i]], "b": names[b[j]], "rho": rho[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "rho": []})


def _correlations_by_blocks(x: DataFrame, names: list[str], method: str, width: int) -> DataFrame:
    many = -(-len(names) // width)
    known = x.sparkSession.createDataFrame([(n, i, i // width) for i, n in enumerate(names)], "feature string, at int, block int")
    series = x.groupBy("feature").agg(F.collect_list(F.struct("row_id", "value")).alias("v")).join(F.broadcast(known), "feature")
    series = series.select("feature", "at", "block", F.col("v.row_id").alias("ids"), F.col("v.value").alias("vs"))
    dealt = series.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1))))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
    tasks = max(1, min(4096, many * (many + 1) // 2))
    out = dealt.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInPandas(lambda pdf: _block_pair(pdf, method), "a string, b string, rho double")
    return out.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def _correlations_by_rows(obs: DataFrame, method: str) -> DataFrame:
    """The same where a feature has more values than a task may hold.

    Features with values in the same rows form a pattern. The rows of two features are those that their
    patterns share, so that a feature is ranked once for each pattern that its own meets, not for each feature.
    """
    tables = Tables(obs.sparkSession)  # values and products are read several times
    x = tables.save(obs.where("value IS NOT NULL").select("row_id", "feature", "value"), "values")
    known = x.join(_patterns(x), "feature")
    rows = known.select(F.col("pattern").alias("other"), "row_id").distinct()
    met = known.join(rows, "row_id").select("row_id", "feature", "value", F.col("pattern").alias("own"), F.least("pattern", "other").alias("lo"), F.greatest("pattern", "other").alias("hi"))
    each = Window.partitionBy("lo", "hi", "feature")
    ranked = met.withColumn("r", _ranked("value", ("lo", "hi", "feature")) if method == "spearman" else F.col("value"))
    flat = F.min("value").over(each) == F.max("value").over(each)
    dots = tables.save(_gram(ranked.withColumn("r", F.when(flat, 0.0).otherwise(F.col("r") - F.avg("r").over(each)))), "products")
    tables.drop(x)
    square = dots.where("a = b").select("lo", "hi", F.col("a").alias("f"), "dot")
    pairs = dots.where("a < b").join(square.toDF("lo", "hi", "a", "own_a"), ["lo", "hi", "a"]).join(square.toDF("lo", "hi", "b", "own_b"), ["lo", "hi", "b"])
    rho = F.when((F.col("own_a") > 0) & (F.col("own_b") > 0), F.col("dot") / F.sqrt(F.col("own_a")) / F.sqrt(F.col("own_b")))
    return pairs.select("a", "b", rho.alias("rho"))


def spearman_pairs(obs: DataFrame) -> DataFrame:
    """(a, b, rho) for a < b, pairwise complete: ranks are those over the rows that a pair shares."""
    return correlations(obs, "spearman")


def corr_prune(pairs: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Features with any earlier one, itself pruned or not, beyond the threshold. Earlier is by name."""
    return pairs.where(F.abs("rho") > threshold).select(F.col("b").alias("feature")).distinct()


def coarse_screen(obs: DataFrame, missing: float = 0.98, std: float = 1e-12, corr: float = 0.98, sample: int | None = None, method: str = "spearman") -> DataFrame:
    """(feature) that pass the missing share, the spread and the correlation screens; the latter two over the last `sample` rows."""
    return screen_report(obs, missing, std, corr, sample, method).where("reason IS NULL").select("feature")


def screen_report(obs: DataFrame, missing: float = 0.98, std: float = 1e-12, corr: float = 0.98, sample: int | None = None, method: str = "spearman") -> DataFrame:
    """(feature, reason): why each feature goes (missing, constant or correlated), or NULL. One without a deviation is constant."""
    some = obs if sample is None else obs.join(obs.select("row_id").distinct().orderBy(F.desc("row_id")).limit(sample), "row_id", "left_semi")
    full = missing_profile(obs).select("feature", "missing")
    spread = missing_profile(some).select("feature", "std")
    first = full.join(spread, "feature", "left").select("feature", F.when(F.col("missing") > missing, "missing").when(~F.coalesce(F.col("std") > std, F.lit(False)), "constant").alias("reason"))
    left = some.join(first.where("reason IS NULL"), "feature", "left_semi")
    dropped = corr_prune(correlations(left, method), corr).withColumn("late", F.lit("correlated"))
    return first.join(dropped, "feature", "left").select("feature", F.coalesce("reason", "late").alias("reason"))


def screen_counts(report: DataFrame, obs: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: features in all, dropped for each reason and kept, and the rows that correlations are taken over."""
    n = lambda cond: F.count(F.when(cond, 1))
    counts = report.agg(F.count("*").alias("n_total"), *(n(F.col("reason") == r).alias(c) for r, c in (("missing", "drop_na"), ("constant", "drop_const"), ("correlated", "drop_corr"))), n(F.col("reason").isNull()).alias("n_kept"))
    rows = obs.agg(F.count_distinct("row_id")).first()[0]
    return counts.withColumn("rows_used_for_corr", F.lit(rows if sample is None else min(rows, sample)).cast("long"))


def importance_counts(importances: DataFrame, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(bound, n): features whose importance reaches each bound."""
    each = F.explode(F.array(*map(F.lit, bounds))).alias("bound")
    return importances.select("importance", each).groupBy("bound").agg(F.count(F.when(F.col("importance") >= F.col("bound"), 1)).alias("n"))


def importance_at_least(importances: DataFrame, bound: float = 260.0) -> DataFrame:
    """(feature, importance) of features whose importance reaches the bound."""
    return importances.where(F.col("importance") >= bound).select("feature", "importance")


def importance_cut(importances: DataFrame, share: float = 0.95) -> DataFrame:
    """(feature, importance, rank, cumulative) down to the one that first reaches the share of the total; no row where the total is 0."""
    order = Window.orderBy(F.desc("importance"), "feature")
    total = F.nullif(F.sum("importance").over(Window.partitionBy()), F.lit(0.0))
    before = F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("importance")
    out = importances.select("feature", "importance", F.row_number().over(order).alias("rank"), (before / total).alias("before"), ((before + F.col("importance")) / total).alias("cumulative"))
    return out.where(F.col("before") < share).drop("before")
