"""Queries that do the whole job where the SQL twin of a like query stops early."""

import numpy as np

from cairn.operators.cleaning import hash_order
from cairn.operators import tendency
from cairn.plans import fixtures as fx, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
QUERIES = registry.queries()


def rows(spark, seed=0):
    got = fx.vectors(spark, SF).orderBy(hash_order(F.col("id"), seed), "id").collect()
    return np.array([r["id"] for r in got]), np.array([r["v"] for r in got], np.float64)


def lloyd(x, k):
    """Labels, inertia and steps of plain Lloyd from the first k rows until no centroid moves."""
    centers, steps = x[:k].copy(), 0
    while True:
        d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2))
        at, steps = d.argmin(axis=1), steps + 1
        moved = np.array([x[at == c].mean(axis=0) if (at == c).any() else centers[c] for c in range(k)])
        if np.abs(moved - centers).max() < 1e-12:
            return at, float((d.min(axis=1) ** 2).sum()), steps
        centers = moved


def test_labels_are_those_of_the_converged_fit(spark):
    ids, x = rows(spark, 1)
    want = dict(zip(ids.tolist(), lloyd(x, 3)[0].tolist()))
    assert {r["id"]: r["cluster"] for r in QUERIES["kmeans_labels_converged"](spark, SF).collect()} == want
    assert {r["id"]: r["cluster"] for r in QUERIES["kmeans_labels"](spark, SF).collect()} != want


def test_search_runs_every_fit_to_its_end(spark):
    _, x = rows(spark, 42)
    for r in QUERIES["kmeans_search_converged"](spark, SF).collect():
        _, inertia, steps = lloyd(x, r["k"])
        assert abs(r["inertia"] - inertia) < 1e-4 and 4 < r["n_iter"] <= steps + 1


def test_spanning_tree_is_that_of_all_rows(spark):
    _, x = rows(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    best, out, total = d[0].copy(), np.arange(len(x)) > 0, 0.0
    while out.any():
        k = int(np.where(out, best, np.inf).argmin())
        total, out[k], best = total + best[k], False, np.minimum(best, d[k])
    assert abs(QUERIES["mst_total_weight_all"](spark, SF).collect()[0]["total_weight"] - total) < 1e-4
    frame = fx.vectors(spark, SF).select("id", "v")
    edges = tendency.spanning_tree(frame, 60, 3).collect()
    assert len(edges) == len(x) - 1 and abs(sum(e["weight"] for e in edges) - total) < 1e-4


def test_hopkins_has_the_probes_and_repetitions_of_the_reference(spark, monkeypatch):
    one = QUERIES["hopkins_500"](spark, SF).collect()[0]
    assert one["m"] == len(rows(spark)[0]) - 1 and 0 < one["hopkins"] <= 1
    asked = []
    whole = tendency.repeated_hopkins
    monkeypatch.setattr(tendency, "repeated_hopkins", lambda v, m, n: asked.append((m, n)) or whole(v, m, n))
    got = QUERIES["repeated_hopkins_summary"](spark, SF).collect()[0]
    assert asked == [(500, 5)] and got["min"] <= got["mean"] <= got["max"]
