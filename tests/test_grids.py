"""Grids that advance together, and bootstraps against full fits, against lone fits and brute force."""

from collections import Counter
from itertools import permutations
from math import log

import numpy as np
import pytest

from cairn.functions.vectors import distances
from cairn.operators import agreement, kmeans, metrics, mixture, scaling
from cairn.runtime import ship


def frame(spark, x):
    ship(spark)
    return spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    return np.concatenate([rng.normal(size=(70, 3)) + c for c in ((0, 0, 0), (6, 0, 0), (0, 7, 1))])


def test_a_mixture_of_a_grid_equals_its_lone_fit(spark, points):
    rows = frame(spark, points)
    grid = [(f"{kind}/{k}/{s}", kind, k, s) for kind in mixture.KINDS for k in (2, 3) for s in (1, 2)]
    many = mixture.fit_many(rows, grid, steps=8)
    for name, kind, k, s in grid[::3]:
        one = mixture.fit(rows, k, kind, s, steps=8)
        assert many[name].bounds == pytest.approx(one.bounds, rel=1e-9)
        assert np.allclose(many[name].means, one.means) and np.allclose(many[name].covariances, one.covariances)
    table, models = mixture.search(rows, (2, 3), ("diag",), 1, 8, starts=2)
    for r in table.collect():
        assert r["lower_bound"] == pytest.approx(max(many[f"diag/{r['k']}/{s}"].bounds[-1] for s in (1, 2)), rel=1e-9)
    assert set(models) == {"diag/2", "diag/3"}


def test_moments_far_from_the_origin_keep_their_digits(spark, points):
    far = points + 1e8
    mean, covariance, n = scaling.mean_and_covariance(frame(spark, far))
    assert n == len(points)
    assert np.allclose(covariance, np.cov(points.T), rtol=1e-6)
    assert np.allclose(mean - 1e8, points.mean(axis=0), atol=1e-6)
    near, away = (mixture.fit(frame(spark, x), 3, "full", 1, steps=6) for x in (points, far))
    assert np.allclose(near.covariances, away.covariances, atol=1e-4)


def lloyd_brute(x, weight, centers, steps=300):
    c = centers.copy()
    for _ in range(steps):
        at = distances(x, c).argmin(axis=1)
        new = np.array([np.average(x[at == j], axis=0, weights=weight[at == j]) if weight[at == j].sum() else c[j] for j in range(len(c))])
        if np.allclose(new, c, atol=0, rtol=0):
            break
        c = new
    return c


def test_bootstraps_of_all_k_equal_lone_weighted_fits(spark, points):
    rng = np.random.default_rng(1)
    rows = frame(spark, points)
    weights = [np.bincount(rng.integers(0, len(points), len(points)), minlength=len(points)) for _ in range(3)]
    draws = spark.createDataFrame([(r, i, int(w)) for r, own in enumerate(weights) for i, w in enumerate(own) if w], "run int, id long, weight long")
    grid = [(k, r) for k in (2, 3) for r in range(3)]
    fits = kmeans.bootstrap_grid(rows, draws, grid, 42)
    from hashlib import md5

    for fit, (k, r) in zip(fits, grid):
        drawn = [i for i in range(len(points)) if weights[r][i]]
        first = sorted(drawn, key=lambda i: (md5(f"{42 + 1000 + r}:{i}".encode()).hexdigest(), i))[:k]
        assert np.allclose(fit.centers, lloyd_brute(points, weights[r].astype(float), points[first]))


def ari_brute(a, b):
    n = len(a)
    same = sum((a[i] == a[j]) == (b[i] == b[j]) for i in range(n) for j in range(i))
    ta, tb = (sum(x[i] == x[j] for i in range(n) for j in range(i)) for x in (a, b))
    pairs, both = n * (n - 1) / 2, (same - n * (n - 1) / 2 + ta + tb) / 2
    expected, most = ta * tb / pairs, (ta + tb) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def test_runs_against_the_reference_of_their_k(spark):
    rng = np.random.default_rng(5)
    reference = {k: rng.integers(0, k, 60) for k in (2, 3)}
    runs = {(k, f"k{k}b{r}"): rng.integers(0, k, 60) for k in (2, 3) for r in range(2)}
    labels = spark.createDataFrame([(i, k, name, int(c)) for (k, name), own in runs.items() for i, c in enumerate(own)], "id long, k long, run_id string, cluster long")
    base = spark.createDataFrame([(i, k, int(c)) for k, own in reference.items() for i, c in enumerate(own)], "id long, k long, cluster long")
    ari, jaccard = agreement.against_reference(labels, base)
    got = {(r["k"], r["run_id"]): r["ari"] for r in ari.collect()}
    assert got == {key: pytest.approx(ari_brute(own, reference[key[0]])) for key, own in runs.items()}
    best = {(r["run_id"], r["cluster"]): r["jaccard"] for r in jaccard.collect()}
    for (k, name), own in runs.items():
        for c in range(k):
            mine = {i for i in range(60) if reference[k][i] == c}
            scores = [len(mine & o) / len(mine | o) for o in ({i for i in range(60) if own[i] == x} for x in range(k)) if o]
            assert best[name, c] == pytest.approx(max(scores))


def information(a, b):
    n, both, ca, cb = len(a), Counter(zip(a, b)), Counter(a), Counter(b)
    return sum(c / n * log(c * n / (ca[x] * cb[y])) for (x, y), c in both.items())


def entropy(a):
    return -sum(c / len(a) * log(c / len(a)) for c in Counter(a).values())


def test_adjusted_mutual_information_by_all_permutations(spark):
    a, b = [0, 0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 1, 0]
    chance = np.mean([information(a, p) for p in permutations(b)])
    got = metrics.expected_mutual_information(list(Counter(a).values()), list(Counter(b).values()))
    assert got == pytest.approx(chance, rel=1e-9)
    rows = spark.createDataFrame([("r", x, y) for x, y in zip(a, b)], "run_id string, cluster long, label long")
    own = metrics.external_of(rows.groupBy("run_id", "cluster", "label").count().withColumnRenamed("count", "n")).first()
    assert own["ami"] == pytest.approx((information(a, b) - chance) / ((entropy(a) + entropy(b)) / 2 - chance))
