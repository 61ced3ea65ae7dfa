import math
import random

import numpy as np
import pytest

from tidemill.llm import whitening as wh


def whole(rows, scale=256):
    """The id and whole vector of the rows that take part."""
    out = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(scale * x) for x in v]))
    return out


def check(found, rows, components=4):
    kept = whole(rows)
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    cov = x.T @ x / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > 1e-12 * values[0]).sum())
    assert len(found) == k * len(kept)
    by = {}
    for r in found:
        by.setdefault((r.id, r.deviation), {})[r.component] = r
    error = {r.identity_error for r in found}
    assert len(error) == 1 and error.pop() <= 1e-10
    w, ours = [], []
    for i, v in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        got = by[(i, deviation)]
        assert sorted(got) == list(range(1, k + 1)) and all(r.n == n for r in got.values())
        w.append(((np.array(v, float) - np.array(sums) / n) @ vectors[:, :k]) / np.sqrt(values[:k]))
        ours.append([got[c].whitened for c in range(1, k + 1)])
        assert [got[c].explained for c in range(1, k + 1)] == pytest.approx((values[:k] / values.sum()).tolist(), rel=1e-9)
    w, ours = np.array(w), np.array(ours)
    sign = np.sign((w * ours).sum(0))
    gap = np.abs(np.diff(values))[:k].min() / values[0] if d > 1 else 1
    assert np.abs(w * sign - ours).max() <= 1e-12 / gap + 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 1, d) + rng.standard_normal(d)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("n", "d"), [(400, 48), (300, 6), (50, 30), (20, 1), (3, 40)])
def test_against_a_dense_solver(spark, n, d):
    rows = vectors(n, n, d)
    rows += [rows[0], (n + 1, rows[0][1]), (None, rows[1][1]), (n + 2, None), (n + 3, [None] * d), (n + 4, [math.nan] + [0.0] * (d - 1)), (n + 5, [math.inf] * d), (n + 6, []), (n + 7, [0.5] * (d + 1))]
    rows += [(n + 10 + k, rows[2][1]) for k in range(100)]  # copies do not weigh
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component int")
    found = wh.whiten(frame.repartition(3)).collect()
    kept = [r for r in rows if r[1] is None or len(r[1]) == d]
    # two rows share an id and a vector: compare the rest, and count these
    twice = [r for r in found if r.id == 0]
    assert len(twice) == 2 * len({r.component for r in twice})
    first = {r.component: r for r in twice}
    check([r for r in found if r.id != 0] + list(first.values()), kept[:n] + kept[n + 1 :])


def test_large_entries_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**k for k in (47, 46, 45)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(wh.whiten(frame).collect(), rows)
    beyond = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        wh.whiten(beyond).collect()


def test_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        found = wh.whiten(spark.createDataFrame(rows, kind))
        assert found.count() == 0 and found.columns[0] == "id"
    assert wh.whiten(spark.range(2)).count() == 0


def dense(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 0, 90), np.r_[10, 9.9, 9.8, 9.7, np.linspace(9.69, 9, 96)], np.r_[[5.0] * 12, [1.0] * 60], np.r_[7.0, np.zeros(70)],
     np.ones(60), np.geomspace(1, 1e-14, 80), np.zeros(50)],
)
def test_pairs_of_hard_spectra(values):
    a = dense(values, 4)
    passes = []

    def times(q):
        passes.append(q.shape[1])
        return a @ q

    found, q, residual = wh.leading_pairs(times, len(values), 4)
    assert np.abs(found - np.sort(values)[::-1][:4]).max() <= 1e-12 * max(values.max(), 1)
    assert residual.max() <= 1e-11 * max(values.max(), 1) and np.abs(q.T @ q - np.eye(4)).max() < 1e-12
    assert len(passes) < 300


def test_polynomial_damps_the_unwanted_part():
    values = np.linspace(0.5, 10, 200)
    out = wh.chebyshev(lambda q: values[:, None] * q, np.ones((200, 1)), 0.5, 8.0, 10.0, 12)[:, 0]
    assert out[-1] == pytest.approx(1) and np.abs(out[values <= 8]).max() < 1e-4


def test_lower_bound():
    for seed in range(5):
        values = np.sort(np.random.default_rng(seed).uniform(3, 9, 70))
        a = dense(values, seed)
        low = wh.lower_bound(lambda q: a @ q, 70, 10, np.random.default_rng(seed))
        assert 0 <= low <= values[0] + 1e-9
