"""Consensus over signatures against the row-wise tree."""

import numpy as np
import pytest

from cairn.operators import ensemble, hierarchy
from cairn.runtime import ship


@pytest.fixture(scope="module")
def labels():
    """Noisy copies of four groups over 23 runs; several rows have the same labels everywhere, one is noise now and then."""
    rng = np.random.default_rng(12)
    group = np.repeat(np.arange(4), 30)
    own = np.stack([np.where(rng.random(120) < 0.12, rng.integers(0, 4, 120), group) for _ in range(23)])
    own[:, 10:20] = own[:, [10]]
    own[3:6, 50] = -1
    return own


def frame(spark, labels):
    ship(spark)
    return spark.createDataFrame([(i, f"r{r:02d}", int(c)) for r, own in enumerate(labels) for i, c in enumerate(own)], "id long, run_id string, cluster long").repartition(4)


def rowwise(labels, ks):
    shared = sum((own[:, None] == own[None, :]) & (own[:, None] >= 0) for own in labels) / len(labels)
    d = 1 - shared.astype(float)
    np.fill_diagonal(d, 0)
    tree = hierarchy.linkage_tree(d, "average")
    return {k: hierarchy.cut_tree(tree, k).tolist() for k in ks}


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("most", [6000, 25])
def test_consensus_of_signatures_equals_the_rowwise_tree(spark, labels, most):
    ks = (2, 3, 4)
    want = rowwise(labels, ks)
    each, rows = ensemble.signatures(frame(spark, labels))
    assert each.count() <= 111 and sum(r["n"] for r in each.collect()) == rows.count() == 120
    got = ensemble.consensus_of(frame(spark, labels), ks, most=most, block=16).collect()
    for k in ks:
        own = [c for _, c in sorted((r["id"], r["cluster"]) for r in got if r["run_id"] == str(k))]
        assert same_parts(own, want[k]), k
        if most > 1000:
            assert own == want[k]


def test_weighted_trees_merge_like_repeated_rows():
    rng = np.random.default_rng(2)
    x, n = rng.random((9, 2)), np.array([1, 3, 1, 2, 5, 1, 1, 4, 2])
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    of = np.repeat(np.arange(9), n)
    long = hierarchy.linkage_tree(d[np.ix_(of, of)], "average")
    assert hierarchy.linkage_tree(d, "average", n)[:, 2] == pytest.approx(long[n.sum() - 9 :, 2])


def test_whole_bases_label_every_row(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 3)) + c for c in ((0, 0, 0), (9, 0, 0))])
    rows = spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "id long, v array<double>")
    bases = ensemble.whole_bases(rows, dimensions=(2, 3), ks=(2, 3), kmeans_seeds=2, steps=5)
    runs = bases.groupBy("run_id").count().collect()
    assert len(runs) == 2 * (2 * 2 + 2 * 2) and all(r["count"] == 80 for r in runs)
    got = dict((r["id"], r["cluster"]) for r in ensemble.consensus_of(bases, (2,)).collect())
    assert len({got[i] for i in range(40)}) == 1 and len({got[i] for i in range(40, 80)}) == 1 and got[0] != got[79]
