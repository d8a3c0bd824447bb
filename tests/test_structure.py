"""Ring index, spanning trees, single linkage, neighbour layout and tree Shapley values against brute force."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.vectors import distances
from cairn.operators import attribution, dbscan, embedding, hierarchy, interpret, pairs, rings, tendency
from cairn.runtime import ship


def frame(spark, x):
    ship(spark)
    return spark.createDataFrame([(int(i), [float(q) for q in r]) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    """Clusters far apart, with repeated rows and ties on a lattice."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 3)) * 40
    x = np.concatenate([c + rng.normal(size=(60, 3)) for c in centers])
    lattice = np.array([[i, j, 200.0] for i in range(6) for j in range(6)], float)
    return np.concatenate([x, lattice, x[:5], x[:5]])


def knn_brute(x, k, metric="euclidean"):
    d = distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    return [sorted((round(float(v), 9), j) for j, v in enumerate(row))[:k] for row in d]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_indexed_neighbours_equal_all_pairs(spark, blobs, metric):
    rows = frame(spark, blobs)
    got = pairs.nearest(rows, rows, 4, metric, block=50).collect()
    best = knn_brute(blobs, 4, metric)
    for r in got:
        d, _ = best[r["id"]][r["rank"] - 1]
        assert r["distance"] == pytest.approx(d, abs=1e-6)
    assert len(got) == 4 * len(blobs)


def test_few_block_pairs_meet_on_clustered_rows(spark, blobs):
    rows = pairs.held(frame(spark, blobs))
    own = rings.deal(rows, rings.reference_points(rows), 50)
    met, every = rings.pairs_met(own, own, rings.worst_neighbour(own, 4, "euclidean", 50))
    assert every == len(own.number) ** 2 > 50
    assert met < 0.6 * every
    alike = frame(spark, np.zeros((30, 3)))
    assert pairs.nearest(alike, alike, 2, block=7).count() == 60


def test_dbscan_within_radius_equals_all_pairs(spark, blobs):
    rows = frame(spark, blobs)
    small = dbscan.fit(rows, [(1.0, 4), (0.6, 3)], block=60).orderBy("s", "id").collect()
    whole = dbscan.fit(rows, [(1.0, 4), (0.6, 3)], block=5000).orderBy("s", "id").collect()
    assert small == whole


def mst_brute(x):
    return sum(w for *_, w in tendency.vat(distances(x, x))[1])


@pytest.mark.parametrize("block", [40, 5000])
def test_spanning_tree_of_all_rows(spark, blobs, block):
    tree = tendency.spanning_tree(frame(spark, blobs), block=block).collect()
    assert len(tree) == len(blobs) - 1
    assert sum(r["weight"] for r in tree) == pytest.approx(mst_brute(blobs), rel=1e-9)


def test_single_linkage_equals_the_tree(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(40, 2)) + c for c in ((0, 0), (9, 0), (0, 9), (30, 30))])
    tree = hierarchy.linkage_tree(distances(x, x), "single")
    got = hierarchy.single_linkage_cuts(frame(spark, x), range(1, 7), block=30).collect()
    for k in range(1, 7):
        own = sorted((r["id"], r["cluster"]) for r in got if r["run_id"] == f"single/euclidean/{k}")
        assert [c for _, c in own] == hierarchy.cut_tree(tree, k).tolist()


def test_curve_and_units():
    assert embedding.curve(0.1) == pytest.approx((1.577, 0.8951), abs=1e-3)
    d = np.sort(np.random.default_rng(0).random((50, 14)), axis=1)
    near, unit = embedding.unit_of(d, math.log2(15))
    assert np.exp(-np.maximum(d - near[:, None], 0) / unit[:, None]).sum(axis=1) == pytest.approx(np.full(50, math.log2(15)), rel=1e-6)
    assert np.isfinite(embedding.unit_of(np.zeros((3, 5)), 2.0)[1]).all()


def trust_brute(x, y, k):
    n = len(x)
    rank = np.argsort(np.argsort(distances(x, x) + np.diag(np.full(n, -1.0)), axis=1), axis=1)
    d = distances(y, y)
    np.fill_diagonal(d, np.inf)
    lost = sum(max(0, rank[i, j] - k) for i in range(n) for j in np.argsort(d[i])[:k])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("seat", [1024, 120])
def test_layout_keeps_neighbours(spark, seat):
    rng = np.random.default_rng(1)
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(400)), 20 * rng.random(400)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], axis=1)
    rows = frame(spark, x)
    flat = embedding.layout(rows, neighbours=12, rounds=5, epochs=25, seat=seat)
    got = sorted((r["id"], r["x"], r["y"]) for r in flat.collect())
    assert [g[0] for g in got] == list(range(400))
    y = np.array([g[1:] for g in got])
    own = embedding.trustworthiness(rows, flat, 10, block=150).first()["trustworthiness"]
    assert own == pytest.approx(trust_brute(x, y, 10), abs=1e-6)
    assert own > 0.95


def test_layout_of_few_rows(spark):
    for x in (np.zeros((0, 2)), np.ones((1, 2)), np.zeros((4, 2)), np.arange(3.0).reshape(3, 1)):
        got = embedding.layout(frame(spark, x), neighbours=5, rounds=2, epochs=2).collect()
        assert len(got) == len(x)
        assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in got)


def shapley_brute(leaves, row, features, classes):
    """All subsets: the tree's expectation with the features of a set known, splits on others by followed weight."""

    def told(known):
        out = np.zeros(classes)
        for leaf in leaves:
            w = 1.0
            for f, (low, high) in leaf.bounds.items():
                w *= float(low < row[f] <= high) if f in known else leaf.follow[f]
            out += w * leaf.share
        return out

    m = len(features)
    out = np.zeros((classes, m))
    for i in range(m):
        rest = [f for f in range(m) if f != i]
        for s in range(m):
            for known in combinations(rest, s):
                out[:, i] += math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) * (told({*known, i}) - told(set(known)))
    return out


def test_tree_shapley_values_equal_enumeration(spark):
    rng = np.random.default_rng(7)
    x = rng.random((600, 4)).round(2)
    label = np.where(x[:, 0] + x[:, 1] > 1.2, 2, np.where(x[:, 2] * x[:, 3] > 0.3, 1, 0))
    rows = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, label))], "id long, a double, b double, c double, d double, cluster long")
    names = ["a", "b", "c", "d"]
    model = interpret.surrogate_tree(rows, names, least=5)[0]
    leaves = attribution.leaves_of(model)
    assert len(leaves) > 6
    got = {r["id"]: np.array(r["contributions"]) for r in attribution.contributions(model, rows, names, keep=["id"]).collect()}
    for i in range(0, 600, 40):
        assert got[i] == pytest.approx(shapley_brute(leaves, x[i], names, 3), abs=1e-12)
    check = attribution.check_additivity(model, rows, names).first()
    assert check["rows"] == 600 and check["largest_error"] < 1e-9
    whole = {r["feature"]: r["mean_absolute_shap"] for r in attribution.importance(model, rows, names).collect()}
    every = np.abs(np.stack([got[i] for i in range(600)])).mean(axis=(0, 1))
    assert [whole[n] for n in names] == pytest.approx(every.tolist())
    mine = {(r["cluster"], r["feature"]): r["mean_absolute_shap"] for r in attribution.importance_by_cluster(model, rows, names).collect()}
    of_two = np.abs(np.stack([got[i][2] for i in range(600) if label[i] == 2])).mean(axis=0)
    assert [mine[2, n] for n in names] == pytest.approx(of_two.tolist())
    null = rows.withColumn("a", F.lit(None).cast("double")).limit(1)
    assert attribution.contributions(model, null, names).count() == 1
