"""Frames and quantiles that are carried along a series, against pandas, percentile and plain sorting."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import sliding, timeseries as ts


def series(n, seed, gaps=0.05):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n)) + 1e4 * (seed % 2)
    x[rng.random(n) < gaps] = np.nan
    x[n // 2 : n // 2 + 40] = 7.25  # a flat stretch
    return x


@pytest.mark.parametrize("w", [1, 2, 5, 21, 63, 252])
@pytest.mark.parametrize(("n", "seed", "gaps"), [(0, 0, 0), (1, 0, 0), (4, 1, 0), (700, 2, 0.01), (700, 3, 0.0), (253, 5, 0.0)])
def test_frames_against_pandas(n, seed, gaps, w):
    x = series(n, seed, gaps)
    got, roll = sliding.frames(x, w), pd.Series(x).rolling(w)
    full = (roll.count() == w).to_numpy() & (np.arange(n) >= w - 1)
    views = np.array([x[max(0, i - w + 1) : i + 1] for i in range(n)], dtype=object)
    for i in range(n):
        own = np.array(views[i], dtype=float)
        if not full[i]:
            assert all(np.isnan(v[i]) for v in got.values())
            continue
        assert got["mean"][i] == pytest.approx(own.mean(), rel=1e-12, abs=1e-10)
        assert np.isnan(got["std"][i]) if w == 1 else got["std"][i] == pytest.approx(own.std(ddof=1), rel=1e-6, abs=1e-10)  # a jump of ten thousand deviations lies beside some frames
        assert got["pos"][i] == pytest.approx((own[-1] - own.min()) / (own.max() - own.min() + 1e-12), rel=1e-12)
        if own.min() == own.max():
            assert got["pos"][i] == 0 and (w == 1 or got["z"][i] == 0)


@pytest.mark.parametrize("w", [1, 7, 126, None])
def test_quantiles_against_plain_sorting(w, monkeypatch):
    monkeypatch.setattr(sliding, "PART", 8)
    x = np.round(series(400, 4), 1)
    got = sliding.earlier_quantiles(x, w, (0.02, 0.5, 0.98))
    for i in range(len(x)):
        own = x[0 if w is None else max(0, i - w) : i]
        own = own[~np.isnan(own)]
        if len(own):
            np.testing.assert_allclose(got[i], np.quantile(own, [0.02, 0.5, 0.98]), rtol=1e-12)
        else:
            assert np.isnan(got[i]).all()


def test_ordered_values_by_chance(monkeypatch):
    monkeypatch.setattr(sliding, "PART", 3)
    rng, own, plain = random.Random(1), sliding.Ordered(), []
    for _ in range(3000):
        if plain and rng.random() < 0.45:
            v = rng.choice(plain)
            plain.remove(v)
            own.drop(v)
        else:
            v = rng.choice([0.0, 1.0, rng.random()])
            plain.append(v)
            own.add(v)
        assert own.size == len(plain) and [own.at(i) for i in range(len(plain))] == sorted(plain)


def test_ten_times_the_series_takes_ten_times_the_time():
    took = []
    for n in (20_000, 200_000):
        x = np.random.default_rng(0).normal(size=n)
        began = time.process_time()
        sliding.earlier_quantiles(x, None, (0.02, 0.98))
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0]


@pytest.mark.parametrize("stretch", [1 << 16, 70])
def test_stretches_change_nothing(spark, monkeypatch, stretch):
    monkeypatch.setattr(sliding, "STRETCH", stretch)
    rows = [(e, i, f, None if np.isnan(v) else float(v)) for e in ("x", None) for f in ("V1", "D1") for i, v in enumerate(series(200, len(f), 0.02))]
    obs = spark.createDataFrame(rows, "who string, row_id long, feature string, value double").repartition(7)
    got = ts.rolling_long(obs, (5, 63), ("mean", "std", "z", "pos"), by=("who", "feature"))
    assert got.columns == ["who", "row_id", "feature", "value"]
    x = F.col("value")
    for w in (5, 63):
        want = obs.select("who", "row_id", "feature", *(v.alias(k) for k, v in ts.rolling(x, w, ("who", "feature")).items())).toPandas()
        for part in ("mean", "std", "z", "pos"):
            own = got.where(F.col("feature").endswith(f"_{part}{w}")).withColumn("feature", F.substring_index("feature", "_", 1)).toPandas()
            both = want.merge(own, on=["who", "row_id", "feature"])
            assert len(both) == len(want) == len(own)
            np.testing.assert_allclose(both[part].astype(float), both["value"].astype(float), rtol=1e-7, atol=1e-9)
    d1 = got.where(F.col("feature").endswith("_d1")).toPandas()
    assert len(d1) == 800 and d1[d1.row_id == 0].value.isna().all()
    for w in (40, None):
        bounds = obs.withColumn("b", ts.winsor_bounds(x, w, by=("who", "feature")))
        want = bounds.select("who", "row_id", "feature", ts.winsorized(x, F.col("b")).alias("v")).toPandas()
        both = want.merge(ts.winsorized_frames(obs, w, by=("who", "feature")).toPandas(), on=["who", "row_id", "feature"])
        assert len(both) == 800
        np.testing.assert_allclose(both.v, both.value, rtol=1e-12)


def test_series_without_rows_or_with_too_wide_frames(spark):
    obs = spark.createDataFrame([], "row_id long, feature string, value double")
    assert ts.base_block(obs).count() == 0 and ts.winsorized_frames(obs, 5).count() == 0
    with pytest.raises(ValueError, match="rows"):
        ts.rolling_long(obs, (1 << 17,), ("mean",))
