"""Lines and trees over time against fits from nothing, and the search against a sequential replay."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import models, search
from marketloom.operators.boosting import Trees
from marketloom.sources import files


def raw(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 0.5 * x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=n)
    x[3:6, 0], y[-1] = np.nan, np.nan
    return x, y


def long_and_labels(spark, x, y):
    none = lambda v: None if np.isnan(v) else float(v)
    obs = [(i, f, none(v)) for i, r in enumerate(x) for f, v in zip(("a", "b"), r)]
    return spark.createDataFrame(obs, "row_id long, feature string, value double").repartition(3), spark.createDataFrame([(i, none(v)) for i, v in enumerate(y)], "row_id long, y double")


def scaled(x, core):
    filled = pd.DataFrame(x).ffill().fillna(0).to_numpy()
    return (filled - filled[:core].mean(0)) / filled[:core].std(0)


def test_lines_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5]) + 3 + 0.01 * rng.normal(size=400)
    for w, c in (models.ridge(x, y), models.descent(x, y)):
        np.testing.assert_allclose([*w, c], [1, -2, 0, 0.5, 3], atol=0.05)
    a = x - x.mean(0)
    np.testing.assert_allclose(models.ridge(x, y)[0], np.linalg.solve(a.T @ a + 1e-4 * 400 * np.eye(4), a.T @ (y - y.mean())), rtol=1e-9)


@pytest.mark.parametrize("by", ["ridge", "descent"])
def test_daily_lines_equal_refits(spark, by):
    x, y = raw()
    obs, labels = long_and_labels(spark, x, y)
    rows = models.line_rows(obs, ["a", "b"], 90).join(labels, "row_id")
    got = (models.daily_lines(rows, 90, 120, 2, 7) if by == "ridge" else models.descended_lines(spark, rows, 90, 120, 2, 7)).orderBy("row_id").toPandas()
    z = scaled(x, 90)
    assert got.row_id.tolist() == list(range(90, 120)) and got.fit.tolist() == [(i - 90) // 7 for i in range(90, 120)]
    w0, c0 = models.LINES[by](z[:90], y[:90])
    for i, r in zip(range(90, 120), got.itertuples()):
        w, c = models.LINES[by](z[:i], y[:i])
        np.testing.assert_allclose([*r.w, r.c, r.linear, r.offline], [*w, c, z[i] @ w + c, z[i] @ w0 + c0], rtol=1e-9, atol=1e-12)


def test_core_line(spark):
    x, y = raw()
    obs, labels = long_and_labels(spark, x, y)
    rows = models.line_rows(obs, ["a", "b"], 90).join(labels, "row_id")
    w, c = models.core_line(rows, 90, 2)
    np.testing.assert_allclose([*w, c], np.append(*models.ridge(scaled(x, 90)[:90], y[:90])), rtol=1e-9)
    got = rows.orderBy("row_id").select(models.dot("x", w, c).alias("v")).toPandas().v
    np.testing.assert_allclose(got, scaled(x, 90) @ w + c)


def forward(spark, x, y, **more):
    obs, labels = long_and_labels(spark, x, y)
    tree = models.vectors(models.carried(obs), ["a", "b"])
    m = Trees(n_estimators=10, min_child_samples=5, num_leaves=6)
    return models.walk_forward(spark, models.line_rows(obs, ["a", "b"], 90), tree, labels, 120, (2, 2), m, hold=30, refit=7, window=60, **more).orderBy("row_id").toPandas(), m


def test_walk_forward_learns_from_the_past_alone(spark):
    x, y = raw()
    got, m = forward(spark, x, y)
    z, t = scaled(x, 90), pd.DataFrame(x).ffill().to_numpy()
    for first in range(90, 120, 7):
        w, c = models.ridge(z[:first], y[:first])
        tree = Trees(**m.settings()).fit(t[first - 60 : first], (y - z @ w - c)[first - 60 : first], np.arange(first - 60, first))
        for i in range(first, min(120, first + 7)):
            w, c = models.ridge(z[:i], y[:i])
            assert got.hybrid[i - 90] == pytest.approx(z[i] @ w + c + tree.predict(t[i : i + 1])[0])
    assert ((got.hybrid - y[90:])[:-1] ** 2).mean() < ((got.linear - y[90:])[:-1] ** 2).mean()
    later = y.copy()
    later[104:] = 99
    pd.testing.assert_frame_equal(got[got.row_id <= 104], forward(spark, x, later)[0][lambda g: g.row_id <= 104])


def test_large_fits_grow_the_same_trees(spark, monkeypatch):
    x, y = raw(60)
    obs, labels = long_and_labels(spark, x, y)
    rows = models.vectors(obs, ["a", "b"]).join(labels, "row_id")
    both = []
    for bound in (10**9, 0):
        monkeypatch.setattr(models, "IN_TASK", bound)
        own = rows.withColumn("fit", (F.col("row_id") % 2).cast("int")).withColumn("learn", F.col("row_id") < 45)
        out = models.fit_each(spark, own, {0: Trees(n_estimators=3, min_child_samples=3), 1: Trees(n_estimators=2, min_child_samples=4, subsample=0.8, subsample_freq=1)}, 2, 120)
        both.append(sorted((r.fit, -1 if r.row_id is None else r.row_id, None if r.row_id is None else round(r.yhat, 9), tuple(r.used or ())) for r in out.collect()))
    assert both[0] == both[1] and len(both[0]) == 17


def test_importance_is_the_mean_over_folds_of_core_rows(spark):
    x, y = raw()
    obs, labels = long_and_labels(spark, x, y)
    rows = models.vectors(obs, ["a", "b"]).join(labels, "row_id")
    m = Trees(n_estimators=4, min_child_samples=5, subsample=0.8, subsample_freq=1)
    core = rows.where("row_id < 90")
    got = {r.feature: r.importance for r in models.tree_importance(spark, core, ["a", "b"], 90, model=m).collect()}
    used = np.mean([Trees(**m.settings()).fit(x[:k], y[:k], np.arange(k)).used for k in range(15, 90, 15)], axis=0)
    assert got == {"a": pytest.approx(used[0]), "b": pytest.approx(used[1])}
    assert models.COUNTED.n_estimators == 3000 and models.COUNTED.max_depth == 20


SMALL = {"n_estimators": (2, 6, False), "learning_rate": (0.05, 0.3, True), "min_child_samples": (4, 9, False)}


def residual_rows(spark, n=100):
    x, y = raw(n, 3)
    obs, labels = long_and_labels(spark, x, y)
    return x, y, models.vectors(obs, ["a", "b"]).join(labels, "row_id")


def test_search_equals_a_sequential_replay(spark):
    x, y, rows = residual_rows(spark)
    plan = search.Plan(trials=14, batch=4, random=6, finished=3, recent=3, stage=4)
    got = search.param_search(spark, rows, 2, 90, plan, train=40, val=5, step=5, ranges=SMALL).orderBy("trial").collect()
    other = search.param_search(spark, rows, 2, 90, search.Plan(trials=14, batch=4, random=6, finished=3, recent=3, stage=1), train=40, val=5, step=5, ranges=SMALL).orderBy("trial").collect()
    assert got == other and len(got) == 14

    def ratio(params, k):
        lo, mid, hi = k * 5, 40 + k * 5, 45 + k * 5
        err = y[mid:hi] - Trees(**params).fit(x[lo:mid], y[lo:mid], np.arange(lo, mid)).predict(x[mid:hi])
        return (err**2).mean() / (y[mid:hi] ** 2).mean()

    done = []
    for start in range(0, 14, 4):
        batch = []
        for number in range(start, min(start + 4, 14)):
            rng = np.random.default_rng([42, number])
            params = search.draw_at_random(rng, SMALL) if number < 6 else search.draw_guided(rng, done, plan, SMALL)
            scores, ratios, pruned = [], [], False
            for k in range(10):
                ratios.append(ratio(params, k))
                scores.append(np.mean(ratios[-3:]))
                others = [t.scores[k] for t in done if not t.pruned]
                if len(others) >= 3 and min(scores) > np.median(others):
                    pruned = True
                    break
            batch.append(search.Trial(number, params, ratios, scores, pruned))
        done += batch
    for r, t in zip(got, done):
        assert json.loads(r.params) == t.params and r.folds == len(t.scores) and r.pruned == t.pruned
        np.testing.assert_allclose(r.ratios, t.ratios)
    assert any(r.pruned for r in got) and any(not r.pruned for r in got)
    assert [r.trial for r in got if r.best] == [min((t for t in done if not t.pruned), key=lambda t: t.scores[-1]).number]


def test_search_and_importance_do_not_see_the_hold_out(spark):
    x, y = raw(200)
    out = []
    for end in (0.0, 99.0):
        later = y.copy()
        later[150:] = end
        obs, labels = long_and_labels(spark, x, later)
        line = models.line_rows(obs, ["a", "b"], 150).join(labels, "row_id")
        w, c = models.core_line(line, 150, 2)
        left = line.where("row_id < 150").select("row_id", (F.col("y") - models.dot("x", w, c)).alias("y"))
        rows = models.vectors(obs, ["a", "b"])
        found = search.param_search(spark, rows.join(left, "row_id"), 2, 150, search.Plan(trials=3, batch=3), train=100, val=21, step=21, ranges=SMALL).orderBy("trial").collect()
        importance = models.tree_importance(spark, rows.join(labels, "row_id").where("row_id < 150"), ["a", "b"], 150, 2, Trees(n_estimators=2)).orderBy("feature").collect()
        assert {r.folds for r in found} == {2}
        out.append(([(r.trial, r.params, r.folds, r.pruned, r.best) for r in found], importance, np.array([*w, c, *(x for r in found for x in r.ratios)])))
    assert out[0][:2] == out[1][:2]
    np.testing.assert_allclose(out[0][2], out[1][2], rtol=1e-8, atol=1e-11)  # sums come in any order


def test_guided_draws_beat_random_ones():
    """On a known function of the eight parameters, over several seeds."""
    ends = {k: (search.span(*v), v[2]) for k, v in search.RANGES.items()}

    def loss(params):
        at = [((np.log(params[k]) if log else params[k]) - lo) / (hi - lo) for k, ((lo, hi), log) in ends.items()]
        return sum((a - 0.25 - 0.06 * i) ** 2 for i, a in enumerate(at))

    def best(seed, random):
        plan, trials = search.Plan(seed=seed, random=random), []
        while batch := search.next_batch(trials, plan):
            for t in batch:
                t.scores.append(loss(t.params))
            trials += batch
        return min(t.scores[-1] for t in trials)

    guided, at_random = [best(s, 10) for s in range(8)], [best(s, 60) for s in range(8)]
    assert np.mean(guided) < 0.8 * np.mean(at_random)
    assert best(3, 10) == best(3, 10)


def test_draws_stay_in_range_and_densities_add_up():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = search.draw_at_random(rng)
        assert all(search.RANGES[k][0] <= v <= search.RANGES[k][1] and isinstance(v, type(search.RANGES[k][0])) for k, v in p.items() if k != "lambda_l1")
    for values in ([], [0.2], [0.0, 0.0, 1.0, 0.7]):
        d = search.Density(np.array(values), 0.0, 1.0)
        grid = np.linspace(0, 1, 20_001)
        assert np.trapezoid(np.exp(d.log(grid)), grid) == pytest.approx(1, abs=1e-3)
        assert ((d.draw(rng, 200) >= 0) & (d.draw(rng, 200) <= 1)).all()


def test_search_without_a_fold(spark):
    _, _, rows = residual_rows(spark)
    got = search.param_search(spark, rows, 2, 50, search.Plan(trials=2, batch=2), train=60, val=5, step=5, ranges=SMALL).collect()
    assert [(r.ratio, r.folds, r.best) for r in got] == [(None, 0, False)] * 2


def test_trees_survive_a_file(spark, tmp_path):
    x, y = raw()
    full = Trees(n_estimators=6, min_child_samples=5, subsample=0.7, subsample_freq=1, colsample_bytree=0.7, lambda_l2=1.0).fit(x[:-1], y[:-1])
    files.save_fitted(spark, full, f"{tmp_path}/m")
    np.testing.assert_array_equal(files.load_fitted(spark, f"{tmp_path}/m").predict(x), full.predict(x))
    assert Trees(n_estimators=5, lambda_l1=1e9).fit(x[:-1], y[:-1]).predict(x) == pytest.approx(np.full(120, y[:-1].mean()))
