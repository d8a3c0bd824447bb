"""Agglomerative clustering of a sample: Lance-Williams trees, cuts and their diagnostics.

The tree of n rows needs their n * n distances, so a sample comes in (``MAX_ROWS``). Each (linkage,
metric) is one task of a grouped map; the sample travels to it once. Single linkage of all rows goes by
their minimum spanning tree (:func:`single_linkage_cuts`) and has no such limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.functions.vectors import distances
from cairn.operators.components import connected
from cairn.operators.pairs import BLOCK, held
from cairn.operators.tendency import spanning_tree
from cairn.runtime import materialize

MAX_ROWS = 6_000
LINKAGES = ("single", "complete", "average", "ward")


def linkage_tree(d: np.ndarray, method: str, sizes: np.ndarray | None = None) -> np.ndarray:
    """Rows (left, right, height, size) in merge order, from a distance matrix; new clusters are numbered from n.

    With ``sizes`` an entry stands for so many rows without a distance between them. Among equal heights the pair that holds the smallest row goes first (then the smallest other).
    """
    n = len(d)
    work = d.astype(np.float64).copy()
    if method == "ward":
        work = work**2
    np.fill_diagonal(work, np.inf)
    size, name, alive = np.ones(n) if sizes is None else np.asarray(sizes, float).copy(), np.arange(n), np.ones(n, bool)
    near = work.argmin(axis=1) if n > 1 else np.zeros(n, int)
    low = work[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i = int(np.argmin(np.where(alive, low, np.inf)))
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        height = work[i, j]
        rows = alive.copy()
        rows[[i, j]] = False
        a, b = work[i], work[j]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * height) / (size[i] + size[j] + size)
        pair = sorted((name[i], name[j]))
        out[step] = (*pair, np.sqrt(max(height, 0)) if method == "ward" else height, size[i] + size[j])
        size[i] += size[j]
        name[i] = n + step
        alive[j] = False
        work[i, :] = np.where(rows, new, np.inf)
        work[:, i] = work[i, :]
        work[j, :] = work[:, j] = np.inf
        low[j] = np.inf
        stale = rows & ((near == i) | (near == j))
        for r in [i, *np.flatnonzero(stale).tolist()]:
            near[r] = int(work[r].argmin())
            low[r] = work[r, near[r]]
        better = rows & (work[:, i] < low)
        near[better], low[better] = i, work[better, i]
    return out


def cut_tree(tree: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters (fewer if the tree is smaller), numbered by their first row."""
    n = len(tree) + 1
    parent = np.arange(2 * n - 1)
    for step in range(max(0, n - k)):
        parent[int(tree[step, 0])] = parent[int(tree[step, 1])] = n + step

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    roots = [root(i) for i in range(n)]
    number = {r: c for c, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots], np.int64)


def cophenetic(tree: np.ndarray) -> np.ndarray:
    """The height at which each pair of rows first shares a cluster."""
    n = len(tree) + 1
    out, members = np.zeros((n, n)), {i: [i] for i in range(n)}
    for step, (a, b, height, _) in enumerate(tree):
        left, right = members.pop(int(a)), members.pop(int(b))
        out[np.ix_(left, right)] = height
        out[np.ix_(right, left)] = height
        members[n + step] = left + right
    return out


def height_for_k(tree: np.ndarray, k: int) -> float:
    """A cut height that gives k clusters: half way between the merges before and after."""
    n, h = len(tree) + 1, tree[:, 2]
    if k >= n:
        return float(h[0] / 2) if len(h) else 0.0
    if k <= 1:
        return float(h[-1] * 1.01) if len(h) else 0.0
    return float((h[n - k - 1] + h[n - k]) / 2)


def fixed_height_k(tree: np.ndarray, ratios=(0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50, 0.45, 0.40, 0.35, 0.30)) -> tuple[float, int]:
    """(height, clusters) of the first ratio of the top height that leaves 2 to n-1 clusters; else the cut into two."""
    n = len(tree) + 1
    for ratio in ratios:
        height = ratio * tree[-1, 2]
        k = n - int((tree[:, 2] <= height).sum())
        if 2 <= k < n:
            return float(height), k
    return height_for_k(tree, 2), 2


def _sample(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = sorted((r["id"], r["v"]) for r in rows.limit(MAX_ROWS + 1).collect())
    if len(got) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: take a sample first")
    return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.float64)


def trees(rows: DataFrame, linkages=LINKAGES, metrics=("euclidean",), ks=range(2, 9)) -> DataFrame:
    """(linkage, metric, kind, id, step, cluster, left, right, height, size): kind ``merge`` has a row for each
    merge, kind ``cut`` one for each sample row and k (in ``step``), kind ``fixed`` the cut at a share of the top height (k in ``step``),
    kind ``cophenetic`` the correlation in height."""
    ids, x = _sample(rows)
    spark = rows.sparkSession
    jobs = spark.createDataFrame([(link, metric) for link in linkages for metric in metrics], "linkage string, metric string")
    shared = spark.sparkContext.broadcast((ids, x))  # MAX_ROWS at most
    cuts = list(ks)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = shared.value
        link, metric = pdf.iloc[0]
        d = distances(x, x, metric)
        tree = linkage_tree(d, link)
        parts = [pd.DataFrame({"kind": "merge", "step": np.arange(1, len(tree) + 1), "left": tree[:, 0].astype("int64"), "right": tree[:, 1].astype("int64"), "height": tree[:, 2], "size": tree[:, 3].astype("int64")})]
        for k in cuts:
            parts.append(pd.DataFrame({"kind": "cut", "step": k, "id": ids, "cluster": cut_tree(tree, k), "height": height_for_k(tree, k)}))
        up = np.triu_indices(len(x), 1)
        height, k = fixed_height_k(tree)
        parts.append(pd.DataFrame({"kind": "fixed", "step": [k], "height": [height]}))
        r = np.corrcoef(cophenetic(tree)[up], d[up])[0, 1] if len(x) > 2 else np.nan
        parts.append(pd.DataFrame({"kind": "cophenetic", "step": [0], "height": [r]}))
        out = pd.concat(parts).assign(linkage=link, metric=metric)
        return out.reindex(columns=["linkage", "metric", "kind", "id", "step", "cluster", "left", "right", "height", "size"]).astype({c: "Int64" for c in ("id", "step", "cluster", "left", "right", "size")})

    return jobs.groupBy("linkage", "metric").applyInPandas(build, "linkage string, metric string, kind string, id long, step long, cluster long, left long, right long, height double, size long")


def single_linkage_cuts(rows: DataFrame, ks=range(2, 9), block: int = BLOCK) -> DataFrame:
    """(id, run_id, cluster, height) of all rows (id, v) for single linkage, without a limit on their number.

    Clusters are what the minimum spanning tree leaves without its k - 1 heaviest edges; ``height`` is the
    lightest of these. Of equal edges the one with the larger ids goes first. Clusters are numbered by their first row.
    """
    spark = rows.sparkSession
    rows = held(rows.select("id", "v"))
    tree = materialize(spanning_tree(rows, block), "tree")
    heavy = tree.orderBy(F.desc("weight"), F.desc("u"), F.desc("v")).limit(max(ks) - 1).collect()  # an edge for each cluster
    gone = spark.createDataFrame([(r["u"], r["v"]) for r in heavy], "u long, v long")
    roots = connected(tree.select("u", "v").join(F.broadcast(gone), ["u", "v"], "left_anti"))
    named = materialize(rows.select("id").join(roots, rows["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root")), "components")
    ends = [x for r in heavy for x in (r["u"], r["v"])]
    root_of = {r["id"]: r["root"] for r in named.where(F.col("id").isin(ends)).collect()} if ends else {}
    every = sorted(r["root"] for r in named.select("root").distinct().collect())  # max(ks) at most
    labels = []
    for k in ks:
        of = {r: r for r in every}

        def find(x: int, of: dict[int, int] = of) -> int:
            while of[x] != x:
                x = of[x]
            return x

        for r in heavy[k - 1 :]:
            a, b = sorted((find(root_of[r["u"]]), find(root_of[r["v"]])))
            of[b] = a
        number = {r: c for c, r in enumerate(sorted({find(x) for x in every}))}
        height = float(heavy[min(k - 1, len(heavy)) - 1]["weight"]) if heavy and k > 1 else None
        labels += [(f"single/euclidean/{k}", x, number[find(x)], height) for x in every]
    known = spark.createDataFrame(labels, "run_id string, root long, cluster long, height double")
    return named.join(F.broadcast(known), "root").select("id", "run_id", "cluster", "height")  # max(ks) rows for each k


def cuts_of(built: DataFrame) -> DataFrame:
    """(id, run_id, cluster) with run_id linkage/metric/k."""
    return built.where("kind = 'cut'").select("id", F.concat_ws("/", "linkage", "metric", F.col("step").cast("string")).alias("run_id"), "cluster")


def agreement_by_k(cuts: DataFrame) -> DataFrame:
    """(k, linkage, ari, level, identical) of Euclidean against Manhattan cuts."""
    from cairn.functions.text import sensitivity_class
    from cairn.operators.agreement import pairwise_ari

    pairs = pairwise_ari(cuts)
    part = lambda c, i: F.get(F.split(c, "/"), F.lit(i))
    same = pairs.where((part(F.col("left"), 0) == part(F.col("right"), 0)) & (part(F.col("left"), 2) == part(F.col("right"), 2)))
    return same.select(part(F.col("left"), 2).cast("long").alias("k"), part(F.col("left"), 0).alias("linkage"), "ari", sensitivity_class(F.col("ari")).alias("level"), (F.abs(F.col("ari") - 1) < 1e-9).alias("identical"))
