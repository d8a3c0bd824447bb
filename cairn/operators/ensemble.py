"""Base clusterings of a sample, their consensus, and the comparison with the best of them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.functions.vectors import distances
from cairn.operators import kmeans, mixture
from cairn.operators.hierarchy import MAX_ROWS, _sample, cut_tree, linkage_tree
from cairn.operators.metrics import evaluate
from cairn.operators.pairs import BLOCK, block_pairs, held
from cairn.operators.selection import rank_sum
from cairn.runtime import materialize, release, sweep

#: Shares of clusters that a part of a table may hold.
PART_BYTES = 64_000_000


def base_grid(dimensions: Sequence[int] = (5, 10, 15, 20), ks: Sequence[int] = range(2, 9), kmeans_seeds: int = 5, gmm_seeds: int = 3, width: int | None = None) -> list[tuple]:
    """(base_id, algorithm, dimension, k, seed, covariance): K-Means and two mixtures for every dimension, Ward
    on the first two dimensions. Dimensions are cut to the width, sorted and distinct."""
    dims = sorted({min(d, width) if width else d for d in dimensions})
    grid = [("kmeans", d, k, s, "") for d in dims for k in ks for s in range(kmeans_seeds)]
    grid += [("gmm", d, k, s, c) for d in dims for k in ks for c in ("diag", "full") for s in range(gmm_seeds)]
    grid += [("ward", d, k, -1, "") for d in dims[:2] for k in ks]
    return [(i, *g) for i, g in enumerate(grid)]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 100) -> tuple[np.ndarray, float]:
    centers = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = distances(x, np.array(centers)).min(axis=1) ** 2
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centers)
    for _ in range(steps):
        d = distances(x, c)
        at = d.argmin(axis=1)
        new = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return at, float((d[np.arange(len(x)), at] ** 2).sum())


def _mixture(x: np.ndarray, k: int, kind: str, rng: np.random.Generator, steps: int = 50) -> tuple[np.ndarray, float, bool]:
    from cairn.operators.mixture import Mixture, _responsibilities

    at, _ = _kmeans(x, k, rng, 10)
    n, d = x.shape
    r = np.zeros((n, k))
    r[np.arange(n), at] = 1
    last, converged = -np.inf, False
    model = Mixture(kind, np.full(k, 1 / k), np.zeros((k, d)), np.zeros(1), n=n)
    for _ in range(steps):
        r0 = r.sum(axis=0) + 10 * np.finfo(float).eps
        model.means = (r.T @ x) / r0[:, None]
        if kind == "full":
            model.covariances = np.stack([((x - model.means[c]) * r[:, [c]]).T @ (x - model.means[c]) / r0[c] + 1e-6 * np.eye(d) for c in range(k)])
        else:
            model.covariances = np.maximum((r.T @ (x * x)) / r0[:, None] - model.means**2, 0) + 1e-6
        model.weights = r0 / r0.sum()
        r, ll = _responsibilities(model, x)
        if abs(ll / n - last) < 1e-3:
            converged = True
            break
        last = ll / n
    return r.argmax(axis=1), -2 * ll + model.parameters * float(np.log(n)), converged


def base_clusterings(rows: DataFrame, grid: list[tuple], seed: int = 42) -> DataFrame:
    """(base_id, algorithm, dimension, k, seed, covariance, inertia, bic, converged, labels): one task for a few
    members of the grid; ``labels`` is a list of (id, cluster). The rows are a sample."""
    ids, x = _sample(rows)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((ids, x))
    jobs = spark.createDataFrame(grid, "base_id long, algorithm string, dimension long, k long, seed long, covariance string")

    def fit(batches):
        ids, x = shared.value
        for pdf in batches:
            out = []
            for job in pdf.itertuples(index=False):
                own = np.ascontiguousarray(x[:, : job.dimension])
                rng = np.random.default_rng([seed, job.base_id])
                inertia = bic = None
                converged = True
                if job.algorithm == "kmeans":
                    at, inertia = _kmeans(own, job.k, rng)
                elif job.algorithm == "gmm":
                    at, bic, converged = _mixture(own, job.k, job.covariance, rng)
                else:
                    at = cut_tree(linkage_tree(distances(own, own), "ward"), job.k)
                out.append((*job, inertia, bic, converged, ids.tolist(), [int(c) for c in at]))
            yield pd.DataFrame(out, columns=["base_id", "algorithm", "dimension", "k", "seed", "covariance", "inertia", "bic", "converged", "ids", "clusters"])

    made = jobs.repartition(min(len(grid), 4 * spark.sparkContext.defaultParallelism), "base_id").mapInPandas(
        fit, "base_id long, algorithm string, dimension long, k long, seed long, covariance string, inertia double, bic double, converged boolean, ids array<long>, clusters array<long>"
    )
    return made


def labels_of(bases: DataFrame) -> DataFrame:
    """(id, run_id, cluster) of all base clusterings."""
    return bases.select(F.col("base_id").cast("string").alias("run_id"), F.explode(F.arrays_zip("ids", "clusters")).alias("z")).select(F.col("z.ids").alias("id"), "run_id", F.col("z.clusters").alias("cluster"))


def consensus(bases: DataFrame, ks: Sequence[int] = range(2, 9)) -> DataFrame:
    """(id, run_id, cluster) of average-linkage cuts of one minus the shares of base clusterings that put two
    rows of the sample together; run_id is k. One task builds the tree, since it needs all of the sample's pairs."""
    spark = bases.sparkSession
    first = bases.select(F.size("ids").alias("n")).limit(1).collect()
    if first and first[0]["n"] > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: take a sample first")
    cuts = list(ks)

    def build(batches):
        shared, n = None, 0
        ids: list[int] = []
        for pdf in batches:
            for own, clusters in zip(pdf["ids"], pdf["clusters"]):
                order = np.argsort(own, kind="stable")
                ids, at = np.asarray(own)[order].tolist(), np.asarray(clusters)[order]
                hot = (at[:, None] == np.unique(at[at >= 0])[None, :]).astype(np.float32)
                shared = hot @ hot.T if shared is None else shared + hot @ hot.T
                n += 1
        if shared is not None:
            d = 1 - shared.astype(np.float64) / n
            np.fill_diagonal(d, 0)
            tree = linkage_tree(d, "average")
            for k in cuts:
                yield pd.DataFrame({"id": ids, "run_id": str(k), "cluster": cut_tree(tree, k)})

    return bases.select("ids", "clusters").coalesce(1).mapInPandas(build, "id long, run_id string, cluster long")  # a row for each member, each with the sample's labels


def whole_bases(rows: DataFrame, dimensions: Sequence[int] = (5, 10, 15, 20), ks: Sequence[int] = range(2, 9), kmeans_seeds: int = 5, gmm_seeds: int = 1, kinds: Sequence[str] = ("diag", "full"), steps: int = 30) -> DataFrame:
    """(id, run_id, cluster) of all rows (id, v) under K-Means and mixtures on the first dimensions: fits over the whole
    table, all members of one dimension together. Ward members need all pairs and stay with :func:`base_clusterings`."""
    rows = held(rows.select("id", "v"))
    width = rows.select(F.size("v")).first()

    def labelled(d: int) -> DataFrame:
        own = materialize(rows.select("id", F.slice("v", 1, d).alias("v")), "dimensions")
        fits = kmeans.lloyd(own, kmeans.start(own, [(k, s) for k in ks for s in range(kmeans_seeds)]), 100)
        models = mixture.fit_many(own, [(f"{kind}/k{k}/s{s}", kind, k, s) for kind in kinds for k in ks for s in range(gmm_seeds)], steps)
        labels = kmeans.assign(own, fits).unionByName(mixture.assign(own, models))
        return materialize(labels.withColumn("run_id", F.concat(F.lit(f"d{d}/"), "run_id")), "base-labels")

    dims = sorted({min(d, width[0]) for d in dimensions}) if width else []
    with ThreadPoolExecutor(max(len(dims), 1)) as pool:  # the jobs of all dimensions side by side
        return reduce(DataFrame.unionByName, pool.map(labelled, dims))


def signatures(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, first, n, codes) of distinct label vectors over all runs, and (id, sig) of all rows.

    ``codes`` are the numbers of the row's (run, cluster) pairs; noise (-1) belongs to no pair. ``sig`` is the smallest id.
    """
    spark = labels.sparkSession
    known = labels.where("cluster >= 0").select("run_id", "cluster").distinct().collect()  # a row for each cluster of each run
    numbered = spark.createDataFrame([(r["run_id"], r["cluster"], x) for x, r in enumerate(sorted(known))], "run_id string, cluster long, code int")
    coded = labels.join(F.broadcast(numbered), ["run_id", "cluster"], "left")  # as above
    rows = materialize(coded.groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("codes")), "label-vectors")
    each = materialize(rows.groupBy("codes").agg(F.min("id").alias("sig"), F.count("*").alias("n")), "signatures")
    return each, materialize(rows.join(each.select("codes", "sig"), "codes").select("id", "sig"), "signature-rows")


def consensus_of(labels: DataFrame, ks: Sequence[int] = range(2, 9), most: int = MAX_ROWS, block: int = BLOCK) -> DataFrame:
    """(id, run_id, cluster): average linkage of one minus the shares of runs that put rows together, for all rows of ``labels``.

    Rows with equal labels in every run are one signature of that weight, so the tree is over signatures. Up to ``most``
    of them one task builds it; more are merged in rounds (:func:`merge_in_rounds`) until so few are left.
    """
    spark = labels.sparkSession
    n_runs = labels.select("run_id").distinct().count()
    each, rows = signatures(labels)
    width = (each.select(F.max(F.array_max("codes"))).first()[0] or 0) + 1
    left = materialize(each.select("sig", "n", F.col("codes"), F.lit(None).cast("array<double>").alias("share")), "clusters")
    to = materialize(each.select("sig", F.col("sig").alias("now")), "merged")
    while left.count() > most:
        was, (left, step) = left, merge_in_rounds(left, n_runs, width, block)
        release(was)
        sweep(spark)  # a round has sent all shares
        to = materialize(to.join(step.withColumnRenamed("sig", "now"), "now").select("sig", F.col("into").alias("now")), "merged")
    cuts = list(ks)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("sig")
        mean = shares_of(table, width)
        d = np.maximum(1 - (mean @ mean.T) / n_runs, 0)
        np.fill_diagonal(d, 0)
        tree = linkage_tree(d, "average", table.column("n").to_numpy())
        sig = table.column("sig").to_numpy()
        return pa.table({"now": np.tile(sig, len(cuts)), "k": np.repeat(np.array(cuts, np.int64), len(sig)), "cluster": np.concatenate([cut_tree(tree, k) for k in cuts])})

    made = left.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(build, "now long, k long, cluster long")  # ``most`` signatures
    labelled = materialize(to.join(materialize(made, "cuts"), "now").select("sig", "k", "cluster"), "signature-cuts")
    return rows.join(labelled, "sig").select("id", F.col("k").cast("string").alias("run_id"), "cluster")


def shares_of(table: pa.Table, width: int) -> np.ndarray:
    """For each cluster the share of its rows that has each code: given, or ones at a signature's codes."""
    out = np.zeros((len(table), width))
    share, codes = (table.column(c).combine_chunks() for c in ("share", "codes"))
    given = np.flatnonzero(share.is_valid().to_numpy(zero_copy_only=False))
    if len(given):
        out[given] = share.take(pa.array(given)).flatten().to_numpy().reshape(len(given), -1)
    alone = np.flatnonzero(share.is_null().to_numpy(zero_copy_only=False))
    if len(alone):
        own = codes.take(pa.array(alone))
        out[np.repeat(alone, np.diff(own.offsets.to_numpy())), own.flatten().to_numpy()] = 1
    return out


def merge_in_rounds(clusters: DataFrame, n_runs: int, width: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """One round of average linkage: clusters that are each other's nearest merge. Returns the clusters left, and (sig, into).

    The average of one minus co-membership between two clusters is one minus the product of their shares, so a pair of
    blocks needs a matrix product only. Average linkage is reducible: merging mutual nearest pairs in any order gives
    the same tree (up to ties, which go to the smaller sig).
    """
    clusters = held(clusters)

    def nearest(a: pa.Table, tiles: list[pa.Table]) -> pa.Table:
        i, own = a.column("id").to_numpy(), shares_of(a, width)
        coarse, slack = own.astype(np.float32), 1.3e-7 * (width + 2) * n_runs
        best, other = np.full(len(a), np.inf), np.full(len(a), np.iinfo(np.int64).max)
        for b in tiles:
            if not len(a) or not len(b):
                continue
            b = b.sort_by("id")
            j = b.column("id").to_numpy()
            far = shares_of(b, width)
            s = coarse @ far.astype(np.float32).T  # off by less than half of ``slack``
            for c in np.flatnonzero(np.isin(j, i)):
                s[i == j[c], c] = -np.inf
            most = s.max(axis=1)
            p, q = np.nonzero((s >= (most - slack)[:, None]) & np.isfinite(most)[:, None])
            d = np.empty(len(p))
            for at in range(0, len(p), 10_000):  # the nearest ones again, exactly
                d[at : at + 10_000] = np.round(1 - np.einsum("ij,ij->i", own[p[at : at + 10_000]], far[q[at : at + 10_000]]) / n_runs, 12)
            first = np.lexsort((j[q], d, p))
            first = first[np.diff(p[first], prepend=-1) != 0]
            p, d, to = p[first], d[first], j[q[first]]
            nearer = (d < best[p]) | ((d == best[p]) & (to < other[p]))
            best[p[nearer]], other[p[nearer]] = d[nearer], to[nearer]
        keep = np.isfinite(best)
        return pa.table({"sig": i[keep], "other": other[keep], "d": best[keep]})

    own = held(materialize(clusters.withColumn("id", F.col("sig")).drop("sig"), "cluster-rows"))
    found = block_pairs(own, own, nearest, "sig long, other long, d double", block, part=PART_BYTES // (8 * width))
    best = materialize(found.groupBy("sig").agg(F.min(F.struct("d", "other")).alias("m")).select("sig", "m.other"), "nearest")
    release(own)
    mutual = best.alias("a").join(best.alias("b"), (F.col("a.other") == F.col("b.sig")) & (F.col("b.other") == F.col("a.sig")))
    step = mutual.select(F.col("a.sig").alias("sig"), F.least("a.sig", "a.other").alias("into"))
    step = materialize(clusters.select("sig").join(step, "sig", "left").select("sig", F.coalesce("into", "sig").alias("into")), "step")

    def joined(batches):
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                one, two = (table.select([f"n{k}", f"codes{k}", f"share{k}"]).rename_columns(["n", "codes", "share"]) for k in (0, 1))
                n, m = (t.column("n").to_numpy() for t in (one, two))
                share = (n[:, None] * shares_of(one, width) + m[:, None] * shares_of(two, width)) / (n + m)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n + m), pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), width).cast(pa.list_(pa.float64()))], ["sig", "n", "share"])

    of = lambda name, k: clusters.select(F.col("sig").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("n", "codes", "share")))
    pair = mutual.select(F.col("a.sig").alias("sig"), F.col("a.other").alias("other")).where("sig < other")
    both = pair.join(of("sig", 0), "sig").join(of("other", 1), "other").select("sig", *(f"{c}{k}" for k in (0, 1) for c in ("n", "codes", "share")))
    merged = both.mapInArrow(joined, "sig long, n long, share array<double>")
    alone = clusters.join(mutual.select(F.col("a.sig").alias("sig")), "sig", "left_anti").select("sig", "n", "codes", "share")
    left = alone.unionByName(merged.select("sig", "n", F.lit(None).cast("array<int>").alias("codes"), "share"))
    return materialize(left, "clusters"), step


def evaluate_bases(bases: DataFrame, rows: DataFrame) -> DataFrame:
    """(base_id, algorithm, parameters, n_records, n_clusters, noise_fraction, measures) of every base clustering of the
    sample ``rows`` (id, v, label); the label is used only here."""
    measured = evaluate(labels_of(bases).join(rows, "id"))
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("base_id", "k", "dimension", "seed", "covariance")]
    own = bases.select("base_id", "algorithm", F.concat_ws(",", *parts).alias("parameters"), F.col("k").alias("requested_k"), F.col("base_id").cast("string").alias("run_id"))
    return own.join(measured, "run_id").drop("run_id")


def best_base(evaluated: DataFrame) -> DataFrame:
    """The base with the least sum of ranks over the internal measures; then the higher silhouette, then the lower id."""
    return rank_sum(evaluated, ties=[F.desc("silhouette"), F.col("base_id")]).orderBy("final_order").limit(1)


def against_best_base(evaluated: DataFrame, consensus_row: DataFrame) -> DataFrame:
    """The best base and the consensus, a row each, in the same measures."""
    measures = ("requested_k", "n_records", "n_clusters", "silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi", "ami", "fowlkes_mallows", "homogeneity", "completeness", "v_measure", "purity")
    named = best_base(evaluated).select(F.concat(F.lit("Best base: "), "algorithm").alias("algorithm"), "parameters", *measures)
    return named.unionByName(consensus_row.select(F.lit("Consensus").alias("algorithm"), F.concat(F.lit("k="), F.col("requested_k").cast("string")).alias("parameters"), *measures))
