"""The whole run on a small table: what it leaves behind, that it goes on where it was ended, and that the hold-out teaches it nothing."""

import json
from dataclasses import replace

import numpy as np
import pytest

from marketloom.operators import models, search
from marketloom.operators.boosting import Trees
from marketloom.plans import tactical
from marketloom.sources import files

COLUMNS = ("M1", "M2", "V1", "V2", "S1", "S2", "E1", "I1", "I2", "P1", "D1")
SETTINGS = tactical.Settings(
    hold=30, counted=Trees(n_estimators=3, min_child_samples=10, lambda_l2=1.0), splits=2, bound=0.5, plan=search.Plan(trials=3, batch=3, random=3),
    ranges={"n_estimators": (2, 5, False), "min_child_samples": (10, 20, False)}, train=150, val=21, step=42, refit=10, window=100,
)


def raw(spark, late=0.0):
    rng = np.random.default_rng(6)
    n = 420
    x = rng.normal(size=(n, len(COLUMNS))).round(3)
    fr = (0.01 * rng.normal(size=n) + 0.004 * x[:, 0]).round(5)
    if late:
        fr[-20:] = late
    rows = [(i, *map(float, r), float(f), 1e-4, float(f) - 1e-4) for i, (r, f) in enumerate(zip(x, fr))]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", forward_returns double, risk_free_rate double, market_forward_excess_returns double").repartition(4)


def near(a, b):
    """Equal, but for the order in which sums were taken."""
    if isinstance(a, dict):
        return set(a) == set(b) and all(near(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(near, a, b))
    return a == pytest.approx(b, rel=1e-8, abs=1e-11) if isinstance(a, float) else a == b


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('run')}/whole"
    return root, tactical.run(spark, raw(spark), root, SETTINGS)


def test_what_a_run_leaves_behind(spark, whole):
    root, record = whole
    assert json.loads(spark.read.text(f"{root}/results").first()[0]) == record
    assert set(record) == {"best_lgbm_params", "pos_params", "hold_adj_sharpe_hybrid", "hold_components_hybrid", "hold_adj_sharpe_linear", "hold_components_linear"} and len(record["hold_components_linear"]) == 7
    table = lambda name: spark.read.parquet(f"{root}/{name}")
    kept = {r.feature for r in table("screen").where("reason IS NULL").collect()}
    importance = {r.feature: r.importance for r in table("importance").collect()}
    assert set(importance) == kept and not kept & {"forward_returns", "risk_free_rate", "excess_returns"} and any(f.startswith("lagged_") for f in kept)
    line = files.load_fitted(spark, f"{root}/linear_model")
    assert line["columns"] == sorted(f for f, v in importance.items() if v >= 0.5) and len(line["weights"]) == len(line["columns"])
    listed = [r[0] for r in spark.read.option("header", True).csv(f"{root}/linear_main_features").collect()]
    assert listed == sorted(line["columns"], key=lambda f: (-importance[f], f))
    scaler = files.load_fitted(spark, f"{root}/linear_scaler")
    n = table("features").agg({"row_id": "max"}).first()[0] + 1
    values = {r.row_id: r.value for r in table("features").where(f"feature = '{scaler['columns'][0]}'").collect()}
    own = np.array([np.nan if values[i] is None else values[i] for i in range(n - 30)])
    own[: np.flatnonzero(~np.isnan(own))[0]] = 0
    assert scaler["mean"][0] == pytest.approx(own.mean()) and scaler["scale"][0] == pytest.approx(own.std())
    forward = table("forward").toPandas()
    assert sorted(forward.row_id) == list(range(n - 30, n))
    assert record["best_lgbm_params"] == json.loads(table("trials").where("best").first().params)


def test_a_run_that_was_ended_goes_on(spark, whole, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/again"
    ended = lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(search, "param_search", ended)
        tactical.run(spark, raw(spark), root, SETTINGS)
    with monkeypatch.context() as m:
        for module, name in ((tactical.build, "build_features"), (tactical.screening, "screen_report"), (models, "tree_importance")):
            m.setattr(module, name, ended)  # what is published is not made again
        first = tactical.run(spark, raw(spark), root, SETTINGS)
        assert near(first, whole[1])
        assert tactical.run(spark, raw(spark), root, SETTINGS) == first
    with pytest.raises(ValueError, match="other settings"):
        tactical.run(spark, raw(spark), root, replace(SETTINGS, hold=31))


def test_the_hold_out_teaches_nothing(spark, whole, tmp_path):
    root = f"file://{tmp_path}/late"
    tactical.run(spark, raw(spark, 99.0), root, SETTINGS)
    for name in ("screen", "importance", "line_on", "line", "trials"):
        a, b = (sorted((tuple(x) for x in spark.read.parquet(f"{r}/{name}").collect()), key=lambda x: str(x[0])) for r in (whole[0], root))
        assert near(a, b), name


def test_no_feature_for_the_line(spark, whole, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="importance"):
        monkeypatch.setattr(tactical.build, "build_features", lambda *a: spark.read.parquet(f"{whole[0]}/features"))
        tactical.run(spark, raw(spark), f"file://{tmp_path}/none", replace(SETTINGS, bound=1e9))
