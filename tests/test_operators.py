"""Edge cases, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import finance
from marketloom.operators import build, features, screening, selection, timeseries as ts, validation
from marketloom.operators.boosting import Trees
from marketloom.sources import files, tables


def frame(spark, values, name="x"):
    return spark.createDataFrame([(i, name, v) for i, v in enumerate(values)], "row_id long, feature string, value double")


def test_rolling_is_strict(spark):
    x = [1.0, 2.0, None, 4.0, 5.0, 6.0, 6.0, 6.0]
    got = frame(spark, x).select("row_id", *(v.alias(k) for k, v in ts.rolling(F.col("value"), 3).items())).orderBy("row_id").toPandas()
    want = pd.Series(x, dtype=float).rolling(3)
    np.testing.assert_allclose(got["mean"], want.mean())
    np.testing.assert_allclose(got["std"], want.std())
    assert got["z"].iloc[-1] == 0 and got["pos"].iloc[-1] == 0


def test_window_of_one_has_no_std(spark):
    r = ts.rolling(F.col("value"), 1)
    assert [x[0] for x in frame(spark, [1.0, 2.0]).select(r["std"]).collect()] == [None, None]


def test_prefix_takes_mom_before_m(spark):
    df = spark.createDataFrame([("MOM1",), ("M1",), ("X1",)], "f string")
    assert [r[0] for r in df.select(ts.prefix_of(F.col("f"))).collect()] == ["MOM", "M", "DEFAULT"]


def test_loose_prefix_and_late(spark):
    rows = [(i, f, 1.0 if i >= s else None) for f, s in (("M1", 0), ("MOM1", 0), ("M2", 30), ("M3", 200)) for i in range(100)]
    got = screening.first_valid_profile(spark.createDataFrame(rows, "row_id long, feature string, value double")).toPandas()
    assert set(got[got.feature == "MOM1"].prefix) == {"M", "MOM"}
    assert set(got[got.late].feature) == {"M2", "M3"}


def test_short_tables(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "row_id long, E1 double")
    assert ts.skip(ts.shifted(df, ["E1"], 10), 62).count() == 0
    assert ts.tail(df, 100).count() == 5
    assert ts.shifted(df, [], 10).count() == 5


def test_pruning_is_not_greedy(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.99), ("a", "c", 0.5)], "a string, b string, rho double")
    assert {r[0] for r in screening.corr_prune(pairs).collect()} == {"b", "c"}


def test_spearman_takes_shared_rows(spark):
    a, b = [1.0, 2.0, 2.0, None, 5.0, 3.0], [3.0, 1.0, 2.0, 9.0, None, 3.0]
    got = screening.spearman_pairs(frame(spark, a, "a").union(frame(spark, b, "b"))).first()["rho"]
    both = pd.DataFrame({"a": a, "b": b}).dropna().rank()
    assert got == pytest.approx(both.corr().iloc[0, 1])


def test_ratio_guards_its_denominator(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 1e-6), (2, 1.0, 2e-6), (3, 1.0, None), (4, None, 0.5)], "row_id long, P1 double, E1 double")
    got = features.interactions(df, flags=True).orderBy("row_id").toPandas()
    assert got["XINT_P1_E1_ratio"].isna().tolist() == [True, True, False, True, True]
    assert got["XINT_P1_E1_ratio_denom_small"].tolist() == [1, 1, 0, 0, 0]  # a missing denominator is not a small one
    assert got["XINT_P1_E1_ratio_miss"].tolist() == [0, 0, 0, 1, 1]
    assert features.interactions(df).columns == ["row_id", "XINT_P1_E1_ratio"]
    assert features.interactions(df, (("P1", "E1", "sum"), ("P1", "X", "diff"))).columns == ["row_id"]


def test_gate_options(spark):
    obs, g = frame(spark, [None, 2.0, 3.0], "S1_z21"), spark.createDataFrame([(0, 1.5), (1, None), (2, 2.0)], "row_id long, g double")
    got = {(r.row_id, r.feature): r.value for r in features.gated(obs, g, "V", missing_term=True, mask=True, least=2, window=3).collect()}
    assert [got[i, "S1_z21_gV"] for i in range(3)] == [0, 0, 6] and [got[i, "S1_z21_gV_unavail"] for i in range(3)] == [1, 1, 0] and [got[i, "S1_z21_gV_miss"] for i in range(3)] == [1.5, 0, 0]
    assert {r.feature for r in features.gated(obs, g, "V").collect()} == {"S1_z21_gV"}


def test_pickers(spark):
    df = spark.createDataFrame([(1, 1.0, True, "x", 1.0, 1.0, 1.0, 1.0)], "date_id long, M1 double, flag boolean, name string, lagged_excess double, XINT_a double, V_pc1 double, excess_returns double")
    assert selection.base_columns(df) == ["M1", "flag"]
    assert selection.main_columns(df) == ["M1", "lagged_excess", "XINT_a", "V_pc1"]
    assert selection.matching(["MOM1_z21", "M1_z21", "M1_z63", "M1_z2"], selection.z_scores({"M": (21, 63), "MOM": (21,)})) == ["MOM1_z21", "M1_z21", "M1_z63"]
    assert selection.matching(["P1_mean5", "P_mean5", "P_x_mean5"], selection.literal_means()) == ["P_mean5", "P_x_mean5"]
    assert selection.matching(["P1_mean5", "V1_mean5"], selection.literal_means(whole_group=True)) == ["P1_mean5"]


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_correlations_of_gappy_features(spark, method):
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.integers(0, 12, (60, 6)).astype(float), columns=list("abcdef"))
    x["c"] = x["a"] * 2 + (x.index % 7 == 0)
    x["flat"] = 3.0
    x.loc[::5, "d"] = np.nan
    x.loc[1::4, "e"] = np.nan
    rows = [(int(i), c, None if np.isnan(v) else float(v)) for c in x for i, v in x[c].items()]
    got = {(r.a, r.b): r.rho for r in screening.correlations(spark.createDataFrame(rows, "row_id long, feature string, value double"), method).collect()}
    want = x.corr(method="pearson") if method == "pearson" else pd.DataFrame({a: {b: x[[a, b]].dropna().rank().corr().iloc[0, 1] if a != b else 1 for b in x} for a in x})
    assert len(got) == 21
    for (a, b), rho in got.items():
        assert (rho is None and np.isnan(want[a][b])) or rho == pytest.approx(want[a][b], abs=1e-12)


def test_screen_reports_why(spark):
    rows = [(i, f, v) for i in range(20) for f, v in (("a", float(i)), ("b", 2.0 * i), ("c", 1.0), ("d", None if i else 1.0), ("e", float(i % 3)))]
    obs = spark.createDataFrame(rows, "row_id long, feature string, value double")
    report = screening.screen_report(obs, missing=0.5, sample=10)
    assert {r.feature: r.reason for r in report.collect()} == {"a": None, "b": "correlated", "c": "constant", "d": "missing", "e": None}
    assert screening.screen_counts(report, obs, 10).first().asDict() == {"n_total": 5, "drop_na": 1, "drop_const": 1, "drop_corr": 1, "n_kept": 2, "rows_used_for_corr": 10}
    assert {r[0] for r in screening.coarse_screen(obs, missing=0.5).collect()} == {"a", "e"}


def raw_table(n, late=0):
    rng = np.random.default_rng(2)
    names = [f"{g}{i}" for g, k in (("V", 5), ("M", 5), ("S", 5), ("I", 5), ("P", 1), ("E", 2), ("MOM", 1), ("D", 1)) for i in range(1, k + 1)]
    x = pd.DataFrame(rng.normal(size=(n, len(names))), columns=names)
    x["I7"] = 1.0
    x.loc[: n - 2, "V5"] = np.nan  # starts on the last day
    for c in selection.LABELS:
        x[c] = 0.01 * rng.normal(size=n)
    return x.assign(row_id=range(n))


def test_feature_build(spark):
    """Names, counts and values of the whole build against pandas; no value sees a later day."""
    n = 420
    x = raw_table(n)
    df = spark.createDataFrame(x.astype(object).where(x.notna(), None), ", ".join(f"{c} {'long' if c == 'row_id' else 'double'}" for c in x))
    got = build.build_features(df).toPandas()
    names = got.feature.value_counts()
    assert (names == n - 72).all() and got.row_id.min() == 0 and got.row_id.max() == n - 73
    every = set(names.index)
    kept = [c for c in x.columns if c not in (*selection.LABELS, "row_id", "V5")]
    each = {"V": 10, "S": 10, "M": 13, "MOM": 7, "E": 10, "P": 10, "I": 7, "D": 7}
    prefix = lambda c: next(p for p in ("E", "S", "V", "MOM", "M", "P", "I", "D") if c.startswith(p))
    assert sum(c.startswith("lagged_") for c in every) == 86
    block = [c for c in every if any(c.startswith(f"{k}_") for k in kept) and "_g" not in c]
    assert len(block) == sum(each[prefix(c)] for c in kept)
    assert {c for c in every if "_pc1" in c and "_g" not in c} == {f"{g}_pc1{s}" for g, z in (("V", 126), ("M", 126), ("MOM", 126), ("S", 252), ("I", 252)) for s in ("", f"_z{z}", "_pos")}
    gates = lambda g: sum(c.endswith(f"_g{g}") for c in every)
    assert gates("E") == 0 and gates("Vstrong") == 5 and gates("V") == 5 + 2 * 5 + 1 + 2 * 2 + 2 + 6
    assert {c for c in every if c.startswith("XINT_")} == {"XINT_I2_I1_diff", "XINT_I7_I1_diff", "XINT_P1_E1_ratio", "XINT_V1_M1_ratio", "XINT_S1_S2_diff"}
    wide = got.pivot(index="row_id", columns="feature", values="value")
    z = x.copy()
    late = [c for c in kept if c[0] in "ES"]
    z[late] = z[late].shift(10)
    z = z.iloc[10:].reset_index(drop=True)
    lag = z["forward_returns"].shift(1)
    z = z.iloc[62:].reset_index(drop=True)
    np.testing.assert_allclose(wide["lagged_forward_returns_z21"], ((lag - lag.rolling(21).mean()) / (lag.rolling(21).std() + 1e-9)).iloc[62:], atol=1e-9)
    for c, w in (("E1", 126), ("S3", 21), ("MOM1", 21)):
        r = z[c].rolling(w)
        np.testing.assert_allclose(wide[f"{c}_z{w}"], (z[c] - r.mean()) / (r.std() + 1e-9), atol=1e-7)
    np.testing.assert_allclose(wide["excess_returns"], z["forward_returns"] - z["risk_free_rate"])
    # The component of V: windows of 126 rows before each, on the z-scores of 21.
    v = wide[[f"V{i}_z21" for i in range(1, 5)]].to_numpy()
    assert wide["V_pc1"].isna().all()  # four columns are too few
    s = wide[[f"S{i}_z21" for i in range(1, 6)]].to_numpy()
    score = np.array([features.first_component(s[t - 126 : t], s[t], 0.98, 5) if t >= 126 else np.nan for t in range(len(s))])
    np.testing.assert_allclose(wide["S_pc1"].to_numpy(dtype=float), score, atol=1e-9)
    zs = (pd.Series(score) - pd.Series(score).rolling(252, min_periods=1).mean()) / pd.Series(score).rolling(252, min_periods=1).std()
    np.testing.assert_allclose(wide["S_pc1_z252"].to_numpy(dtype=float), zs, atol=1e-7)
    np.testing.assert_allclose(wide["S_pc1_pos"].to_numpy(dtype=float), zs.clip(lower=0), atol=1e-7)
    np.testing.assert_allclose(wide["I1_z63_gV"].to_numpy(dtype=float), wide["I1_z63"].fillna(0).to_numpy(dtype=float))  # the gate of NULLs is 1
    assert len(v) == n - 72


def test_feature_build_of_few_columns_and_rows(spark):
    df = spark.createDataFrame([(i, float(i), 0.1 * i) for i in range(100)], "row_id long, M1 double, forward_returns double")
    got = build.build_features(df, build.Build(burn=5)).toPandas()
    assert got.row_id.nunique() == 95 and "lagged_forward_returns_mean5" in set(got.feature) and "excess_returns" not in set(got.feature) and not [f for f in set(got.feature) if f.endswith("_gV")]
    assert build.build_features(df, build.Build(burn=5, complete_only=True)).count() < len(got)
    assert build.build_features(df.limit(20)).count() == 0


def test_components_across_parts(spark, monkeypatch):
    """Rows dealt to several tasks, by entity and over all rows before."""
    monkeypatch.setattr(features, "DAYS", 7)
    rng = np.random.default_rng(1)
    x = {e: rng.normal(size=(40, 6)) for e in ("a", "b")}
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(pd.concat([pd.DataFrame(m, columns=names).assign(row_id=range(40), who=e) for e, m in x.items()]))
    for window in (12, None):
        for r in features.causal_pc1(df, names, window, 15, by="who").collect():
            want = features.first_component(x[r.entity][0 if window is None else r.row_id - window : r.row_id], x[r.entity][r.row_id], 0.98, 5) if r.row_id >= 15 else None
            assert (r.pc1 is None) == (want is None) and (want is None or r.pc1 == pytest.approx(want))


def test_position_rule_and_modes(spark):
    df = spark.createDataFrame([(0.01, None, None), (0.01, 0.01, -0.1), (-5.0, 1.0, 0.0)], "p double, v double, m double")
    got = [r[0] for r in df.select(finance.position_rule(F.col("p"), F.col("v"), F.col("m"))).collect()]
    assert got[0] == pytest.approx(2) and got[1] == 1 and got[2] == pytest.approx(0)
    with pytest.raises(ValueError):
        finance.to_position(F.col("p"), "forward return")


def test_sharpe_without_variance_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.01, 1.0)] * 5, "risk_free_rate double, forward_returns double, position double")
    assert finance.adjusted_sharpe(df).first()["adjusted_sharpe"] == 0
    none = finance.adjusted_sharpe(df.where("false")).first()
    assert none["adjusted_sharpe"] == 0 and none["n_days"] == 0
    with pytest.raises(ValueError):
        finance.adjusted_sharpe(df, mode="forward return")


def test_sharpe_parts(spark):
    rng = np.random.default_rng(3)
    rf, fr, p = np.full(50, 1e-4), 0.01 * rng.normal(size=50), rng.uniform(-1, 3, 50)
    got = finance.adjusted_sharpe(spark.createDataFrame([tuple(map(float, r)) for r in zip(rf, fr, p)], "risk_free_rate double, forward_returns double, position double")).first()
    pos = p.clip(0, 2)
    ret = rf * (1 - pos) + pos * fr
    mean = np.prod(1 + ret - rf) ** (1 / 50) - 1
    assert got.strat_mean_excess == pytest.approx(mean) and got.sharpe == pytest.approx(mean / ret.std() * 252**0.5) and got.strategy_vol_annual == pytest.approx(ret.std() * 252**0.5 * 100)
    assert got.adjusted_sharpe == pytest.approx(got.sharpe / got.vol_penalty / got.return_penalty)


def test_distribution_and_entities(spark):
    df = spark.createDataFrame([(e, i, r) for e in "ab" for i, r in enumerate((0.0011, None, -0.0002, 0.0013))], "who string, row_id long, ret double")
    assert {round(r.low, 6): r.n for r in finance.distribution(df, width=0.001).collect()} == {0.001: 4, -0.001: 2}
    t = finance.turnover(df, "ret", by="who").toPandas()
    assert t.turnover.isna().sum() == 6 and sorted(ts.tail(df, 2, by="who").toPandas().row_id) == [0, 0, 1, 1]

@pytest.mark.parametrize(("n", "folds"), [(772, 0), (773, 1), (793, 1), (794, 2)])
def test_fold_counts(spark, n, folds):
    assert validation.rolling_folds(spark, n).count() == folds


def test_component_is_causal_and_matches_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    df = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=[f"c{i}" for i in range(6)]).assign(row_id=range(len(m))))
    score = lambda m: features.causal_pc1(df(m), [f"c{i}" for i in range(6)], 30, 30, q=1.0).orderBy("row_id").toPandas()["pc1"]
    got = score(x)
    y = x.copy()
    y[50:] += 100
    np.testing.assert_array_equal(got[:50], score(y)[:50])
    t = x[10:40]
    v = np.linalg.svd(t - t.mean(0))[2][0]
    clipped = np.clip(x[40], t.min(0), t.max(0))
    assert abs(got[40]) == pytest.approx(abs((clipped - t.mean(0)) @ v))


def test_folds_with_embargo_and_a_limit(spark):
    got = validation.rolling_folds(spark, 900, embargo=5, most=2).orderBy("fold").collect()
    assert [(r.tr_start, r.tr_end, r.va_start, r.va_end) for r in got] == [(0, 747, 752, 773), (16, 768, 773, 794)]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, float("nan"), None)], "row_id long, v double, s string")
    for kind in ("csv", "parquet"):
        at = f"{tmp_path}/t.{kind}"
        files.write_table(df, at, kind)
        got = files.read_table(spark, at).orderBy("row_id").collect()
        assert [(r.row_id, r.v, r.s) for r in got] == [(1, 2.0, "x"), (2, None, None)]
    files.write_feature_list(spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0)], "feature string, importance double"), f"{tmp_path}/f")
    assert [r[0] for r in spark.read.option("header", True).csv(f"{tmp_path}/f").collect()] == ["c", "a", "b"]
    files.write_results(spark.createDataFrame([(1.5, {"k": 2.0})], "score double, parts map<string, double>"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().parts.k == 2.0
    model = Trees(n_estimators=2, min_child_samples=1).fit(np.arange(8.0).reshape(4, 2), np.arange(4.0))
    files.save_fitted(spark, model, f"{tmp_path}/m")
    np.testing.assert_array_equal(files.load_fitted(spark, f"{tmp_path}/m").predict(np.ones((1, 2))), model.predict(np.ones((1, 2))))
    files.save_fitted(spark, {"weights": [1.0, 2.0], "intercept": 0.5}, f"{tmp_path}/l")
    assert files.load_fitted(spark, f"{tmp_path}/l") == {"weights": [1.0, 2.0], "intercept": 0.5}


def test_shared_folder_of_a_session_without_one():
    class Session:
        class conf:
            get = staticmethod(lambda name, other: other)

        class sparkContext:
            master, applicationId = "local[2]", "app-of-a-test"

    one = tables.shared_dir(Session)
    assert one.startswith("file://") and tables.shared_dir(Session) == one
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session)
