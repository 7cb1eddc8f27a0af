"""Lines and trees that are fitted again as time goes on, from rows that Spark deals to each fit.

Rows are (row_id, x array of doubles, y); row_id is dense from 0. A fit is a range of rows, and its rows come to
it by an equi-join on row_id. Lines need sums of products alone: those of all earlier blocks of days are added
up once, whatever number of days asks for them. Trees of a fit are grown in one task where its rows are few,
and by Spark aggregations over all tasks where they are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import timeseries as ts, validation
from .boosting import Trees, boosted
from ..functions.finance import adjusted_sharpe, position_rule
from ..sources.tables import Tables

#: Values of a fit, rows times columns, that one task may hold.
IN_TASK = 20_000_000
#: The last rows held out, the days after which trees are fitted again, and the rows they are fitted on.
HOLD, REFIT, TREE_ROWS = 180, 21, 504
#: The trees that importances are counted in.
COUNTED = Trees(n_estimators=3000, learning_rate=0.03, num_leaves=126, max_depth=20, min_child_samples=50, subsample=0.8, subsample_freq=1, colsample_bytree=0.8, lambda_l2=5.0)


def vectors(obs: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, x): the values of each row in the order of columns, NULL where it has none."""
    of = F.map_from_entries(F.collect_list(F.struct("feature", "value")))
    rows = obs.where(F.col("feature").isin(columns)).groupBy("row_id").agg(of.alias("of"))
    return rows.select("row_id", F.transform(F.array(*map(F.lit, columns)), lambda c: F.try_element_at("of", c)).alias("x"))


def carried(obs: DataFrame, backward: bool = False) -> DataFrame:
    """Gaps filled from before; with backward, which looks ahead, leading ones from after."""
    return obs.withColumn("value", ts.filled(F.col("value"), backward))


def line_rows(obs: DataFrame, columns: list[str], core_end: int, backward: bool = False) -> DataFrame:
    """(row_id, x) for lines: gaps carried, leading ones 0, and scaled by the rows before core_end."""
    filled = carried(obs.where(F.col("feature").isin(columns)), backward).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return vectors(validation.standard_scale(filled, core_end), columns)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squares with a penalty of alpha on the weights, in closed form."""
    a = np.column_stack([x, np.ones(len(x)), y])
    return ridge_of(a.T @ a, alpha)


def ridge_of(gram: np.ndarray, alpha: float = 1e-4) -> tuple[np.ndarray, float]:
    """The same from the sums of products of (x, 1, y)."""
    d, n = len(gram) - 2, gram[-2, -2]
    mean, my = gram[:d, d] / n, gram[d, d + 1] / n
    inner = gram[:d, :d] - n * np.outer(mean, mean) + alpha * n * np.eye(d)
    w = np.linalg.solve(inner, gram[:d, d + 1] - n * mean * my)
    return w, float(my - mean @ w)


def descent(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4, eta: float = 0.01, power: float = 0.25, epochs: int = 1000, tol: float = 1e-3, patience: int = 5, seed: int = 42) -> tuple[np.ndarray, float]:
    """The same line by stochastic descent, a row a step in an order drawn anew each epoch; the step shrinks with the power of the steps so far.

    Ends when the mean loss has not fallen by tol for `patience` epochs.
    """
    rng, w, c, t, best, waited = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0, 1, np.inf, 0
    for _ in range(epochs):
        loss = 0.0
        for i in rng.permutation(len(x)):
            rate, off = eta / t**power, float(x[i] @ w) + c - y[i]
            w = w * (1 - rate * alpha) - rate * off * x[i]
            c -= rate * off
            loss += off * off / 2
            t += 1
        loss /= len(x)
        waited = waited + 1 if loss > best - tol else 0
        best = min(best, loss)
        if waited >= patience:
            break
    return w, c


LINES = {"ridge": ridge, "descent": descent}


def matrix(x) -> np.ndarray:
    """Lists of doubles as rows, NULL as NaN."""
    return np.array([[np.nan if v is None else v for v in r] for r in x], dtype=float).reshape(len(x), -1 if len(x) else 0)


def dealt(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Columns of tasks (fit, lo, hi, …) and of rows, for the rows from lo up to hi."""
    each = tasks.where("lo < hi").withColumn("row_id", F.explode(F.sequence("lo", F.col("hi") - 1))).drop("lo", "hi")
    return each.join(rows, "row_id")


def grams(rows: DataFrame, block: Column) -> DataFrame:
    """(block, cell, v): sums of products of (x, 1, y) by block of rows, the upper triangle row by row. Rows without y do not count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("block").to_numpy()
            a = np.column_stack([matrix(b.column("x").to_pylist()), np.ones(len(at)), b.column("y").to_numpy()])
            for k in np.unique(at).tolist():
                own = a[at == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, g in sums.items():
            v = g[np.triu_indices(len(g))]
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(v), k, dtype=np.int64)), "cell": pa.array(np.arange(len(v), dtype=np.int64)), "v": pa.array(v)})

    known = rows.where("y IS NOT NULL AND x IS NOT NULL").select(block.cast("long").alias("block"), "x", "y")
    return known.mapInArrow(add, "block long, cell long, v double").groupBy("block", "cell").agg(F.sum("v").alias("v"))


def square(cells: np.ndarray, values: np.ndarray, d: int) -> np.ndarray:
    g = np.zeros((d + 2, d + 2))
    i, j = np.triu_indices(d + 2)
    g[i[cells], j[cells]] = values
    return g + np.triu(g, 1).T


def daily_lines(rows: DataFrame, start: int, n: int, d: int, refit: int = REFIT) -> DataFrame:
    """(row_id, fit, w, c, linear, offline) of the rows from start to n: the line of all rows before each, and its guess and that of the rows before start.

    Sums of products are taken once over all rows, by stretches of `refit` days; a task starts from the sum of
    the stretches before its own and adds its days one by one.
    """
    many = -(-(n - start) // refit)
    block = F.greatest(F.floor((F.col("row_id") - start) / refit), F.lit(-1))
    upto = grams(rows.where(F.col("row_id") < n), block).groupBy("cell").agg(F.collect_list(F.struct("block", "v")).alias("of"))
    before = lambda k: F.aggregate(F.filter("of", lambda o: o.block < k), F.lit(0.0), lambda s, o: s + o.v)
    sums = upto.select("cell", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("fit")).select("fit", "cell", before(F.col("fit")).alias("v"), before(F.lit(0)).alias("core"))
    own = rows.where((F.col("row_id") >= start) & (F.col("row_id") < n)).select(block.cast("long").alias("fit"), "row_id", "x", "y")

    def run(cells: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("row_id")
        x, y = matrix(days["x"]), days["y"].to_numpy(dtype=float)
        g, core = (square(cells["cell"].to_numpy(), cells[k].to_numpy(), d) for k in ("v", "core"))
        out, (w0, c0) = [], ridge_of(core) if core[-2, -2] else (np.zeros(d), 0.0)
        for i in range(len(days)):
            w, c = ridge_of(g) if g[-2, -2] else (np.zeros(d), 0.0)
            out.append((days["row_id"].iloc[i], days["fit"].iloc[i], w, c, float(x[i] @ w + c), float(x[i] @ w0 + c0)))
            if not np.isnan(y[i]):
                a = np.concatenate([x[i], [1.0, y[i]]])
                g += np.outer(a, a)
        return pd.DataFrame(out, columns=["row_id", "fit", "w", "c", "linear", "offline"])

    return own.groupBy("fit").cogroup(sums.groupBy("fit")).applyInPandas(lambda days, cells: run(cells, days), "row_id long, fit long, w array<double>, c double, linear double, offline double")


def descended_lines(spark: SparkSession, rows: DataFrame, start: int, n: int, d: int, refit: int = REFIT) -> DataFrame:
    """daily_lines by stochastic descent, which has no sums to start from: a stretch of days gets all rows before it."""
    tasks = spark.range(0, -(-(n - start) // refit)).select(F.col("id").alias("fit"), F.lit(0).cast("long").alias("lo"), F.least(F.lit(start) + (F.col("id") + 1) * refit, F.lit(n)).alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x, y, out = matrix(pdf["x"]), pdf["y"].to_numpy(dtype=float), []
        fitted = lambda i: descent(x[:i][~np.isnan(y[:i])], y[:i][~np.isnan(y[:i])])
        w0, c0 = fitted(start)
        for i in range(start + int(pdf["fit"].iloc[0]) * refit, len(pdf)):
            w, c = fitted(i)
            out.append((i, pdf["fit"].iloc[0], w, c, float(x[i] @ w + c), float(x[i] @ w0 + c0)))
        return pd.DataFrame(out, columns=["row_id", "fit", "w", "c", "linear", "offline"])

    return dealt(rows, tasks).groupBy("fit").applyInPandas(run, "row_id long, fit long, w array<double>, c double, linear double, offline double")


def core_line(rows: DataFrame, core_end: int, d: int) -> tuple[np.ndarray, float]:
    """The line of the rows before core_end, from one sum of products."""
    cells = grams(rows.where(F.col("row_id") < core_end), F.lit(0)).toPandas()  # a number for each pair of columns
    return ridge_of(square(cells["cell"].to_numpy(), cells["v"].to_numpy(), d)) if len(cells) else (np.zeros(d), 0.0)


def dot(x: str, w: np.ndarray, c: float) -> Column:
    products = F.zip_with(x, F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(c)), lambda s, v: s + v)


def fit_each(spark: SparkSession, rows: DataFrame, models: dict[int, Trees], d: int, values: int) -> DataFrame:
    """(fit, row_id, yhat, used): guesses at the rows of rows (fit, row_id, x, y, learn) that are not learnt from, and a row without row_id with how often the fit's trees split by each column.

    values is the most that a fit holds, rows times columns: up to IN_TASK a fit is a task, which gets its rows by a shuffle, beyond
    it all fits grow together by aggregations. The trees are the same.
    """
    schema = "fit int, row_id long, yhat double, used array<double>"
    if values > IN_TASK:
        made = boosted(spark, rows.where("learn").select("fit", "row_id", "x", "y"), models, d)
        sent = spark.sparkContext.broadcast(made)

        def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fits, x, out = b.column("fit").to_numpy(), matrix(b.column("x").to_pylist()), np.zeros(b.num_rows)
                for f in np.unique(fits).tolist():
                    out[fits == f] = sent.value[f].predict(x[fits == f])
                yield pa.RecordBatch.from_pydict({"fit": pa.array(fits.astype(np.int32)), "row_id": b.column("row_id"), "yhat": pa.array(out), "used": pa.nulls(len(fits), pa.list_(pa.float64()))})

        counts = spark.createDataFrame([(f, None, None, m.used.tolist()) for f, m in made.items()], schema)
        return rows.where("NOT learn").select("fit", "row_id", "x").mapInArrow(guess, schema).union(counts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fit"].iloc[0])
        pdf = pdf.sort_values("row_id")
        x, learn = matrix(pdf["x"]), pdf["learn"].to_numpy(dtype=bool)
        y, ids = pdf["y"].to_numpy(dtype=float), pdf["row_id"].to_numpy()
        own = learn & ~np.isnan(y)
        model = replace(models[f]).fit(x[own], y[own], ids[own])
        out = pd.DataFrame({"fit": f, "row_id": pd.array(ids[~learn], dtype="Int64"), "yhat": model.predict(x[~learn]), "used": None})
        last = pd.DataFrame({"fit": [f], "row_id": pd.array([None], dtype="Int64"), "yhat": [np.nan], "used": [model.used]})
        return pd.concat([out, last]) if len(out) else last

    return rows.repartition(min(4096, max(1, len(models))), "fit").groupBy("fit").applyInPandas(run, schema)


def tree_importance(spark: SparkSession, rows: DataFrame, columns: list[str], n: int, splits: int = 5, model: Trees = COUNTED) -> DataFrame:
    """(feature, importance): splits a feature serves in, on average over expanding folds of rows (row_id, x, y), which are n. Rows without a target are left out."""
    d = len(columns)
    tasks = validation.expanding_folds(spark, n, splits).select(F.col("fold").cast("int").alias("fit"), F.col("tr_start").alias("lo"), F.col("tr_end").alias("hi"))
    found = fit_each(spark, dealt(rows, tasks).withColumn("learn", F.lit(True)), {f: model for f in range(splits)}, d, n * d)
    each = found.where("row_id IS NULL").select(F.posexplode("used").alias("at", "used"))
    names = spark.createDataFrame(list(enumerate(columns)), "at int, feature string")
    return names.join(each, "at", "left").groupBy("feature").agg((F.coalesce(F.sum("used"), F.lit(0.0)) / splits).alias("importance"))


def walk_forward(spark: SparkSession, line: DataFrame, tree: DataFrame, labels: DataFrame, n: int, widths: tuple[int, int], trees: Trees = Trees(), by: str = "ridge", hold: int = HOLD, refit: int = REFIT, window: int = TREE_ROWS) -> DataFrame:
    """(row_id, linear, offline, hybrid) for the last `hold` of n rows, from line and tree (row_id, x) of so many columns each, and labels (row_id, y).

    linear is a line fitted each day on all earlier rows, offline the line of the core rows alone, hybrid linear
    and the trees' guess at its residual. Trees are fitted again each `refit` days on the last `window` rows and the
    residuals of that day's line. Rows without a target are predicted but not learnt from.
    """
    start = max(2, n - hold)
    tables = Tables(spark)
    known = tables.save(line.withColumnRenamed("x", "line").join(tree.withColumnRenamed("x", "tree"), "row_id").join(labels, "row_id").select("row_id", "line", "tree", "y"), "rows")
    own = known.select("row_id", F.col("line").alias("x"), "y")
    lines = tables.save(daily_lines(own, start, n, widths[0], refit) if by == "ridge" else descended_lines(spark, own, start, n, widths[0], refit), "lines")
    many = -(-(n - start) // refit)
    first = F.lit(start) + F.col("id") * refit
    tasks = spark.range(many).select(F.col("id").cast("int").alias("fit"), first.alias("first"), F.greatest(first - window, F.lit(0)).alias("lo"), F.least(first + refit, F.lit(n)).alias("hi"))
    opening = lines.where((F.col("row_id") - start) % refit == 0).select(F.col("fit").cast("int").alias("fit"), "w", "c")  # a row a stretch
    rest = F.col("y") - F.aggregate(F.zip_with("line", "w", lambda a, b: a * b), F.col("c"), lambda s, v: s + v)
    rows = dealt(known, tasks).join(opening, "fit").select("fit", "row_id", F.col("tree").alias("x"), rest.alias("y"), (F.col("row_id") < F.col("first")).alias("learn"))
    guesses = fit_each(spark, rows, {k: trees for k in range(many)}, widths[1], (window + refit) * widths[1]).where("row_id IS NOT NULL").select("row_id", "yhat")
    out = tables.save(lines.join(guesses, "row_id").select("row_id", "linear", "offline", (F.col("linear") + F.col("yhat")).alias("hybrid")), "predictions")
    tables.drop(known, lines)
    return out


def held_positions(pred: DataFrame, wide: DataFrame, prediction: str, vol: str = "lagged_forward_returns_std21", mom: str = "lagged_forward_returns_mean21") -> DataFrame:
    """(row_id, forward_returns, risk_free_rate, position) of predictions by the position rule; wide has the labels, vol and mom."""
    rows = pred.join(wide.select("row_id", "forward_returns", "risk_free_rate", F.col(vol).alias("vol"), F.col(mom).alias("mom")), "row_id")
    return rows.select("row_id", "forward_returns", "risk_free_rate", position_rule(F.col(prediction), F.col("vol"), F.col("mom")).alias("position"))


def walk_forward_scores(pred: DataFrame, wide: DataFrame, **rule: str) -> DataFrame:
    """(model, n_days, the parts of the score, adjusted_sharpe) for the hybrid, the daily line and the offline line on the rows whose return is known."""
    out = None
    for model in ("hybrid", "linear", "offline"):
        held = held_positions(pred, wide, model, **rule).where("forward_returns IS NOT NULL AND risk_free_rate IS NOT NULL")
        one = adjusted_sharpe(held).select(F.lit(model).alias("model"), "*")
        out = one if out is None else out.union(one)
    return out
