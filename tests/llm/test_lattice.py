import math

import numpy as np
import pytest

from postflock.llm import lattice


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(0, 2, (2000, 8))
    found = lattice.decode(y)
    near = found[:, None] + np.concatenate([np.zeros((1, 8)), lattice.roots()])
    assert (((y[:, None] - near) ** 2).sum(-1).argmin(1) == 0).all()
    whole = np.abs(found - np.rint(found)).max(1) < 1e-9
    assert whole.any() and not whole.all() and (np.rint(2 * found).astype(int).sum(1) % 4 == 0).all()
    assert len(np.unique(lattice.roots(), axis=0)) == 240 and np.allclose((lattice.roots() ** 2).sum(1), 2)


def brute(rows):
    good = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, group = [0] * len(rows), list(range(len(rows)))
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, i in enumerate(good):
        for j in good[a + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                n[i] += 1
                n[j] += 1
                group[root(i)] = root(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    out = [(key, n[i], least.get(root(i))) for i, (key, *_) in enumerate(rows)]
    return [(k, m, c, k is not None and k == c) for k, m, c in out]


def run(spark, rows):
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Embedding int")
    return [tuple(r) for r in lattice.near_duplicates(data).select("vec_id", "n_links", "component_id", "kept").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple(-9 if x is None else x for x in r))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = []
    for size in [1] * 150 + [2] * 40 + [5] * 10 + [200]:
        base = rng.normal(size=64)
        for _ in range(size):
            v = base + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.1])
            rows.append((int(3 * len(rows) % 2003), (v * rng.choice([1.0, 3.5])).tolist(), 0))
    rows += [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 64, 0), (9003, [1.0] * 63 + [None], 0), (9004, [float("nan")] * 64, 0), (9005, [float("inf")] * 64, 0)]
    rows += [(None, rows[0][1], 0), (None, rng.normal(size=64).tolist(), 0), (9006, [1.0, 0.0, 0.0], 0), (9007, [5e-320, -0.0, 0.0], 0), (9008, [1e300, 1e299, 0.0], 0)]
    rows += [rows[5], rows[5]]
    assert order(run(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize("width", [3, 64, 768])
@pytest.mark.parametrize("points", [1, 2, 3, 4])
def test_recall_at_the_threshold(width, points):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = lattice.cells(a, points), lattice.cells(0.95 * a + np.sqrt(1 - 0.95**2) * b, points)
    met = (x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)
    assert met.any(1).mean() >= 0.99


def test_unlike_vectors_hardly_meet():
    """However many there are: cells get more points as the table grows."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for n in (500, 2_000, 20_000):
        own = lattice.cells(v[:n], lattice.points_for(n), 1)[:, 0, 0]
        assert (np.unique(own, return_counts=True)[1] ** 2).sum() / n - 1 < 0.2
    assert [lattice.points_for(n) for n in (0, 30, 5_000, 500_000, 10**8)] == [1, 1, 2, 3, 4]


@pytest.mark.parametrize("points", [1, 2, 3])
def test_blocks_and_large_groups(spark, monkeypatch, points):
    """A pair is counted once, wherever it meets and however its cell is dealt out."""
    for name, value in (("BLOCK", 16), ("LARGE", 6), ("PAIRS", 50)):
        monkeypatch.setattr(lattice, name, value)
    monkeypatch.setattr(lattice, "points_for", lambda n: points)
    rng, rows = np.random.default_rng(9), []
    for size in [1] * 60 + [2] * 20 + [9] * 5 + [120]:
        base = rng.normal(size=32)
        rows += [(len(rows) + i, (base + rng.normal(size=32) * rng.choice([0.0, 0.06, 0.12])).tolist(), 0) for i in range(size)]
    assert order(run(spark, rows)) == order(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 0)]) == [(1, 0, 1, True)]
