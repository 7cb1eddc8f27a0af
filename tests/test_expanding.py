"""The component over all earlier rows against a fit a day, and what its parts are dealt."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from marketloom.operators import expanding, features, sliding
from pyspark.sql import functions as F

NAMES = [f"c{i}" for i in range(6)]


def table(spark, entities: dict[str | None, np.ndarray]):
    rows = [(e, i, *(None if np.isnan(v) else float(v) for v in row)) for e, m in entities.items() for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "who string, row_id long, " + ", ".join(f"{c} double" for c in NAMES))


def odd_series() -> dict[str, np.ndarray]:
    """Gaps and empty rows, ties, steps and trends through all bounds, late, dead and far-off columns."""
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(150, 6))
    gaps = np.where(rng.random((150, 6)) < 0.3, np.nan, plain)
    gaps[20:30], gaps[:60, 1], gaps[:, 2] = np.nan, np.nan, np.nan
    ties = np.round(plain)
    ties[:, 0] = 1.0
    return {
        "plain": plain, "gaps": gaps, "ties": ties, "trend": plain + np.arange(150)[:, None] * [0.1, -0.1, 0.5, 0, 1, -1], "far": plain + 1e6,
        "steps": plain + 10 * (np.arange(150)[:, None] // 40 % 2), "short": plain[:5], "one": plain[:1], "none": np.full((40, 6), np.nan),
    }


@pytest.mark.parametrize("q,days", [(0.98, 8), (0.7, 16), (0.5, 8), (1.0, 8)])
def test_equals_a_fit_a_day(spark, monkeypatch, q, days):
    monkeypatch.setattr(features, "DAYS", days)
    x = odd_series()
    got = {(r.entity, r.row_id): r.pc1 for r in features.causal_pc1(table(spark, x), NAMES, None, 20, q, 4, by="who").collect()}
    assert len(got) == sum(map(len, x.values()))
    scores = 0
    for e, m in x.items():
        for t in range(len(m)):
            want = features.first_component(m[:t], m[t], q, 4) if t >= 20 else float("nan")
            if np.isnan(want):
                assert got[e, t] is None, (e, t)
            else:
                scores += 1
                assert got[e, t] == pytest.approx(want, rel=1e-7, abs=1e-6 if e == "far" else 1e-9), (e, t)
    assert scores > 700


def test_later_rows_change_nothing_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(features, "DAYS", 8)
    x = odd_series()["plain"]
    y = x.copy()
    y[100:] = 1e3
    a, b = ([r.pc1 for r in features.causal_pc1(table(spark, {"a": m}), NAMES, None, 20, by="who").orderBy("row_id").collect()] for m in (x, y))
    assert a[20:100] == pytest.approx(b[20:100], rel=1e-12) and a[101:] != pytest.approx(b[101:], rel=1e-3)
    assert features.causal_pc1(table(spark, {"a": x}).where("false"), NAMES, None, 20).count() == 0
    assert features.causal_pc1(table(spark, {None: x[:30]}), NAMES, None, 20, by="who").count() == 0
    assert features.causal_pc1(table(spark, {"a": x[:30]}), NAMES, None, 20).where("pc1 IS NOT NULL").count() == 10
    clash = table(spark, {"a": x[:30]}).withColumns({c: F.lit(7) for c in ("entity", "part", "x", "off", "top", "col")})
    assert features.causal_pc1(clash, NAMES, None, 20).where("pc1 IS NOT NULL").count() == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.just(float("nan"))), min_size=1, max_size=60), st.sampled_from([0.5, 0.8, 1.0]), st.sampled_from([1, 4, 7]))
def test_sides_hold_on_every_day(values, q, days):
    """In each part a side tells what a value is clipped to on all of the part's days."""
    x = np.array(values)
    low, high = sliding.earlier_quantiles(x, None, (1 - q, q)).T
    side, moves = np.full(len(x), expanding.FREE), {part: (rows, to) for part, rows, to in expanding.moves(x, low, high, days)}
    for start in range(days, len(x), days):
        if start // days in moves:
            rows, to = moves[start // days]
            assert (rows < start).all() and len(set(rows)) == len(rows)
            side[rows] = to
        for t in range(start, min(len(x), start + days)):
            for i in (i for i in range(start) if x[i] == x[i] and side[i] != expanding.PASSED):
                assert np.clip(x[i], low[t], high[t]) == {expanding.FREE: x[i], expanding.LOW: low[t], expanding.HIGH: high[t]}[side[i]]


def test_what_is_dealt_grows_with_the_days(spark):
    """Four times the days get about four times the rows, not sixteen times."""
    sizes = []
    for n in (2048, 8192):
        x = np.random.default_rng(5).normal(size=n)
        low, high = sliding.earlier_quantiles(x, None, (0.02, 0.98)).T
        moved = [len(rows) for _, rows, _ in expanding.moves(x, low, high, 128)]
        sizes.append(sum(moved) / n)
    assert sizes[1] < 1.2 * sizes[0] < 0.5


def test_sign_of_columns_that_mirror_each_other():
    """Equal loadings of opposite signs: the first column's is positive, however the rounding falls."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.normal(size=(40, 3)) * [0.1, 1, 0.1]
        m = np.column_stack([x[:, 0], x[:, 1], -x[:, 1] * (1 + 1e-13), x[:, 2]])
        load = expanding.leading(np.cov(m.T))
        assert load[1] > 0 > load[2] and abs(load[1] + load[2]) < 1e-6
