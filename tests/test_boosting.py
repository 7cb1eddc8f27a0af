"""Trees: splits against plain search in both directions, best-first order, and growth by Spark against growth in one task."""

import heapq
import itertools

import numpy as np
import pytest

from marketloom.operators import boosting
from marketloom.operators.boosting import Trees


def table(seed, n=240, d=4, gaps=0.25):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = np.round(2 * (x[:, 0] > 0.2) + np.where(x[:, 1] > 0, x[:, 1], -1) + rng.normal(size=n), 2)
    x[rng.random((n, d)) < gaps] = np.nan
    y += 1.5 * np.isnan(x[:, 2])
    return x, y


def brute_split(m, codes, rest, allowed):
    """(gain, column, bin, missing left) of the best of all splits, by going through rows."""
    best = None
    worth = lambda r: max(abs(r.sum()) - m.lambda_l1, 0) ** 2 / (len(r) + m.lambda_l2)
    for low, j, b in itertools.product((True, False), range(codes.shape[1]), range(m.bins)):
        left = np.where(codes[:, j] == 0, low, codes[:, j] <= b)
        if not allowed[j] or min(left.sum(), (~left).sum()) < m.min_child_samples:
            continue
        gain = worth(rest[left]) + worth(rest[~left]) - worth(rest)
        if best is None or gain > best[0] + 1e-9:
            best = gain, j, b, low
    return best if best and best[0] > 1e-9 else None


def brute_tree(m, codes, rest, allowed, depth):
    """Splits of a tree grown best first, by plain search; nodes by number as the library has them."""
    rows = {1: np.arange(len(codes))}
    open_, out = [], {}

    def look(node):
        if len(rows[node]) >= 2 * m.min_child_samples and node.bit_length() <= depth and (s := brute_split(m, codes[rows[node]], rest[rows[node]], allowed)):
            heapq.heappush(open_, (-round(s[0], 9), node, s))

    look(1)
    while open_ and len(out) + 1 < m.num_leaves:
        _, node, (_, j, b, low) = heapq.heappop(open_)
        out[node] = j, b, low
        code = codes[rows[node], j]
        left = np.where(code == 0, low, code <= b)
        rows[2 * node], rows[2 * node + 1] = rows[node][left], rows[node][~left]
        look(2 * node)
        look(2 * node + 1)
    return out


@pytest.mark.parametrize(("leaves", "depth", "l1", "l2", "columns"), [(2, -1, 0.0, 0.0, 1.0), (6, -1, 0.0, 1.0, 1.0), (31, 3, 2.0, 5.0, 0.5), (31, -1, 0.0, 0.1, 0.75)])
def test_one_tree_against_plain_search(leaves, depth, l1, l2, columns):
    for seed in range(4):
        x, y = table(seed, gaps=0.25 * (seed % 2))
        m = Trees(n_estimators=1, learning_rate=1.0, num_leaves=leaves, max_depth=depth, min_child_samples=9, lambda_l1=l1, lambda_l2=l2, colsample_bytree=columns, bins=8).fit(x, y)
        codes = m.coded(x).astype(int)
        want = brute_tree(m, codes, y - y.mean(), m.columns_of(0, x.shape[1]), depth if depth > 0 else 99)
        tree, got, place = m.made[0], {}, {0: 1}
        for i, c in enumerate(tree.column):
            if c >= 0:
                got[place[i]] = int(c), int(tree.bin[i]), bool(tree.missing_left[i])
                place[int(tree.left[i])], place[int(tree.right[i])] = 2 * place[i], 2 * place[i] + 1
        assert got == want and m.used.sum() == len(want)
        left = y - m.base - tree.values(m.coded(x))
        for leaf in np.unique(tree.values(m.coded(x))):
            own = tree.values(m.coded(x)) == leaf
            if l1 == 0:
                assert (y - m.base)[own].sum() / (own.sum() + l2) == pytest.approx(leaf) and len(left) == len(y)


def test_missing_values_may_go_right():
    x = np.array([[1.0], [2.0], [3.0], [4.0], [np.nan], [np.nan]])
    for y, low in (([0, 0, 5, 5, 5, 5], False), ([0, 0, 5, 5, 0, 0], True)):
        m = Trees(n_estimators=1, learning_rate=1.0, num_leaves=2, min_child_samples=1).fit(x, np.array(y, dtype=float))
        assert m.made[0].missing_left[0] == low
        np.testing.assert_allclose(m.predict(x), y)
    m = Trees(n_estimators=1, learning_rate=1.0, num_leaves=2, min_child_samples=1).fit(x, np.array([0.0, 0, 0, 0, 9, 9]))
    np.testing.assert_allclose(m.predict(x), [0, 0, 0, 0, 9, 9])


def test_bag_is_a_share_and_the_same_anywhere():
    ids = np.arange(20_000)
    own = boosting.in_bag(ids, 3, 0.8, 42)
    assert abs(own.mean() - 0.8) < 0.02 and (own[500:600] == boosting.in_bag(ids[500:600], 3, 0.8, 42)).all()
    assert (own != boosting.in_bag(ids, 4, 0.8, 42)).any()
    m = Trees(subsample=0.5)
    assert m.bag(ids, 0).all() and not Trees(subsample=0.5, subsample_freq=2).bag(ids, 0).all()
    two = Trees(subsample=0.5, subsample_freq=2)
    assert (two.bag(ids, 0) == two.bag(ids, 1)).all() and (two.bag(ids, 1) != two.bag(ids, 2)).any()


def test_growth_by_spark_equals_growth_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SAVED", 2)
    models = {
        0: Trees(n_estimators=3, learning_rate=0.5, num_leaves=7, min_child_samples=8, lambda_l2=1.0, bins=16),
        1: Trees(n_estimators=2, learning_rate=0.3, num_leaves=20, max_depth=3, min_child_samples=5, subsample=0.7, subsample_freq=1, colsample_bytree=0.6, lambda_l1=0.5, bins=8, seed=5),
        2: Trees(n_estimators=3, min_child_samples=500),
        3: Trees(n_estimators=2),
    }
    tables = {f: table(f, n=150 + 40 * f) for f in (0, 1, 2)}
    rows = [(f, i, [None if np.isnan(c) else float(c) for c in v], float(t)) for f, (x, y) in tables.items() for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (0, 999, None, 1.0), (1, 998, [1.0] * 4, None)], "fit int, row_id long, x array<double>, y double").repartition(5)
    got = boosting.boosted(spark, df, models, 4)
    for f, (x, y) in tables.items():
        want = Trees(**models[f].settings()).fit(x, y)
        assert [c.tolist() for c in got[f].cuts] == [c.tolist() for c in want.cuts] and got[f].base == pytest.approx(want.base)
        for a, b in zip(got[f].made, want.made):
            for k in ("column", "bin", "missing_left", "left", "right"):
                np.testing.assert_array_equal(getattr(a, k), getattr(b, k))
            np.testing.assert_allclose(a.value, b.value, atol=1e-12)
        np.testing.assert_allclose(got[f].predict(x), want.predict(x))
        np.testing.assert_array_equal(got[f].used, want.used)
    assert got[3].made == [] and got[3].predict(np.zeros((2, 4))).tolist() == [0, 0]


def test_no_columns_and_no_rows():
    m = Trees(n_estimators=2).fit(np.zeros((3, 0)), np.array([1.0, 2.0, 3.0]))
    assert m.predict(np.zeros((2, 0))).tolist() == [2, 2]
    assert Trees(n_estimators=2).fit(np.full((30, 1), np.nan), np.arange(30.0)).predict(np.zeros((1, 1))) == pytest.approx([14.5])
