"""A clustering fitted again from what a result table says about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.operators import dbscan, hierarchy, kmeans, mixture


def refit(rows: DataFrame, algorithm: str, k: int | None = None, linkage: str | None = None, seed: str | int | None = None, covariance: str | None = None, eps: str | float | None = None, min_samples: str | int | None = None) -> DataFrame:
    """(id, run_id, cluster) of a family (kmeans, hierarchical, gmm, dbscan) with these parameters on ``rows`` (id, v).

    A parameter that the family needs and the table lacks is a ValueError; so is an unknown family.
    """

    def need(name: str, value):
        if value is None:
            raise ValueError(f"{algorithm} needs {name}")
        return value

    start = int(seed) if seed is not None else 42
    if algorithm == "kmeans":
        made = kmeans.assign(rows, kmeans.lloyd(rows, kmeans.start_apart(rows, [(need("k", k), start)])))
    elif algorithm == "hierarchical":
        made = hierarchy.cuts_of(hierarchy.trees(rows, [linkage or "ward"], ks=[need("k", k)]))
    elif algorithm == "gmm":
        made = mixture.assign(rows, {"gmm": mixture.fit(rows, need("k", k), covariance or "full", seed=start)})
    elif algorithm == "dbscan":
        made = dbscan.dbscan(rows, float(need("eps", eps)), int(need("min_samples", min_samples)))
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    return made.select("id", F.lit(algorithm).alias("run_id"), "cluster")
