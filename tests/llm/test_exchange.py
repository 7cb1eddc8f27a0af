"""Exchange clustering against the full likelihood, worked out anew for every move."""

import numpy as np
import pytest

from marketloom.llm import brown


def likelihood(pairs, of, k):
    one = np.zeros((len(pairs), k))
    one[np.arange(len(pairs)), of] = 1
    table = one.T @ pairs @ one
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(1)) - f(table.sum(0))


def counts(seed, size, density):
    rng = np.random.default_rng(seed)
    return (rng.integers(1, 40, (size + 2, size + 2)) * (rng.random((size + 2, size + 2)) < density)).astype(float)


@pytest.mark.parametrize(("seed", "size", "classes", "density"), [(0, 12, 3, 0.5), (1, 20, 4, 0.3), (2, 9, 2, 0.9), (3, 15, 5, 0.15), (4, 3, 5, 0.8), (5, 1, 2, 1.0)])
def test_every_move_is_the_best_one(seed, size, classes, density):
    pairs, k = counts(seed, size, density), classes + 2
    of = np.append(np.arange(size) % classes, [classes, classes + 1])
    for _ in range(6):
        for w in range(size):
            gains = [likelihood(pairs, np.where(np.arange(size + 2) == w, c, of), k) for c in range(classes)]
            best = max(gains)
            of[w] = next(c for c, g in enumerate(gains) if g > best - 1e-7)
    got = brown.exchange(pairs, classes, 6)
    assert got[-2:].tolist() == [classes, classes + 1]
    assert likelihood(pairs, got, k) == pytest.approx(likelihood(pairs, of, k), abs=1e-6)
    settled = brown.exchange(pairs, classes, 200)
    here = likelihood(pairs, settled, k)
    assert all(likelihood(pairs, np.where(np.arange(size + 2) == w, c, settled), k) <= here + 1e-6 for w in range(size) for c in range(classes))


def test_words_of_the_same_neighbours_share_a_class():
    rng = np.random.default_rng(1)
    kind = np.arange(40) % 4
    pairs = np.zeros((42, 42))
    for i in range(40):
        for j in range(40):
            if kind[j] == (kind[i] + 1) % 4:
                pairs[i, j] = rng.integers(20, 40)
    got = brown.exchange(pairs, 4, 30)[:40]
    assert len({(a, b) for a, b in zip(kind, got)}) == 4
