"""Correlations of wide tables, by blocks of features and by rows, against pandas."""

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import screening


def wide(n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) + rng.normal(size=(n, 1)), 1)
    for j in range(d):
        x[: rng.integers(0, n // 3) * (j % 3), j] = np.nan
        x[rng.random(n) < 0.1 * (j % 4 == 1), j] = np.nan
    x[:, 2], x[: n // 2, 3], x[n // 2 :, 4], x[:, 5] = 1.5, np.nan, np.nan, np.nan
    return pd.DataFrame(x, columns=[f"f{j:03d}" for j in range(d)])


def long(spark, table):
    rows = [(i, c, None if np.isnan(v) else float(v)) for c in table for i, v in enumerate(table[c])]
    return spark.createDataFrame(rows, "row_id long, feature string, value double").repartition(4)


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("values", [1 << 24, 60 * 2 * 3, 10])
def test_correlations_against_pandas(spark, method, values):
    table = wide(60, 11, 1)
    got = {(r.a, r.b): r.rho for r in screening.correlations(long(spark, table), method, values).collect()}
    for a in table:
        for b in table:
            own = table[[a, b]].dropna()
            if a >= b or not len(own):
                assert (a, b) not in got
            elif own[a].nunique() < 2 or own[b].nunique() < 2:
                assert got[a, b] is None
            else:
                x, y = (own[c].rank() if method == "spearman" else own[c] for c in (a, b))
                assert got[a, b] == pytest.approx(x.corr(y), abs=1e-9)


def test_a_thousand_features(spark):
    table = wide(80, 1000, 2)
    got = screening.correlations(long(spark, table)).toPandas()
    want = table.corr("spearman").to_numpy()
    at = {c: i for i, c in enumerate(table)}
    own = want[got.a.map(at), got.b.map(at)]
    assert len(got) > 480_000
    few = table.notna().to_numpy().T.astype(int) @ table.notna().to_numpy().astype(int)
    known = (few[got.a.map(at), got.b.map(at)] > 1) & ~np.isnan(own)
    np.testing.assert_allclose(got.rho[known].astype(float), own[known], atol=1e-9)


def test_correlations_of_nothing(spark):
    none = spark.createDataFrame([], "row_id long, feature string, value double")
    assert screening.correlations(none).collect() == []
    with pytest.raises(ValueError):
        screening.correlations(none, "kendall")
