"""Queries that fit clusterings: K-Means, hierarchies, DBSCAN, mixtures, stability, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import agreement, dbscan, ensemble, hierarchy, kmeans, metrics, mixture, pairs, scaling
from cairn.operators.cleaning import bootstrap_draws, hash_sample
from cairn.plans import fixtures as fx
from cairn.plans.registry import query
from cairn.runtime import materialize

#: Lloyd steps that SQL repeats.
STEPS = 4
SAMPLE = 2_500


def _rows(spark, d):
    return fx.vectors(spark, d).select("id", "v")


def _sample(spark, d, n=SAMPLE):
    return materialize(hash_sample(_rows(spark, d), n, 42, "id"), "sample")


def _lloyd_sql(k: int, seed: int, steps: int, tag: str) -> str:
    """CTEs c<t>, a<t> (assignments to c<t>, with squared distance) for t up to ``steps``."""
    parts = [f"{tag}c0 AS (SELECT row_number() OVER (ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1 AS cluster, v AS c FROM vec QUALIFY cluster < {k})"]
    for t in range(steps + 1):
        parts.append(f"{tag}a{t} AS (SELECT id, any_value(v) AS v, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) ** 2 AS sq FROM (SELECT vec.id, vec.v, c.cluster, list_distance(vec.v, c.c) AS dist FROM vec, {tag}c{t} c) GROUP BY id)")
        if t < steps:
            mean = f"SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM {tag}a{t}) GROUP BY ALL) GROUP BY cluster"
            parts.append(f"{tag}c{t + 1} AS (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM {tag}c{t} o LEFT JOIN ({mean}) n USING (cluster))")
    return ", ".join(parts)


def _fits(rows, grid, steps=STEPS):
    return kmeans.lloyd(rows, kmeans.start(rows, grid), steps, tolerance=-1.0)


@query("kmeans_labels", f"WITH {fx.VECTORS}, {_lloyd_sql(3, 1, STEPS, 'm')} SELECT id, 'k3s1' AS run_id, cluster FROM ma{STEPS}")
def kmeans_labels(spark, d):
    rows = _rows(spark, d)
    return kmeans.assign(rows, _fits(rows, [(3, 1)]))


@query(
    "kmeans_search",
    f"WITH {fx.VECTORS}, " + ", ".join(_lloyd_sql(k, 42, STEPS - 1, f"k{k}_") for k in (2, 3, 4, 5)) + " " + " UNION ALL ".join(f"SELECT 'k{k}s42' AS run_id, {k} AS k, 42 AS seed, {STEPS} AS n_iter, sum(sq) AS inertia FROM k{k}_a{STEPS - 1}" for k in (2, 3, 4, 5)),
    doubles="inertia",
    longs="k seed n_iter",
)
def kmeans_search(spark, d):
    rows = _rows(spark, d)
    return kmeans.search_table(spark, _fits(rows, [(k, 42) for k in (2, 3, 4, 5)]))


@query("kmeans_labels_converged")
def kmeans_labels_converged(spark, d):
    """The clustering itself; ``kmeans_labels`` stops after the steps that SQL repeats."""
    rows = _rows(spark, d)
    return kmeans.assign(rows, kmeans.lloyd(rows, kmeans.start(rows, [(3, 1)])))


@query("kmeans_search_converged")
def kmeans_search_converged(spark, d):
    """Every fit to its end; ``kmeans_search`` stops after the steps that SQL repeats."""
    rows = _rows(spark, d)
    return kmeans.search_table(spark, kmeans.search(rows, (2, 3, 4, 5))[0])


@query(
    "kmeans_convergence",
    f"WITH {fx.VECTORS}, {_lloyd_sql(3, 42, 4, 'm')} " + " UNION ALL ".join(f"SELECT {t + 1} AS iteration_budget, {t + 1} AS actual_iterations, sum(sq) AS inertia FROM ma{t}" for t in range(5)),
    doubles="inertia",
    longs="iteration_budget actual_iterations",
)
def kmeans_convergence(spark, d):
    return kmeans.convergence(_rows(spark, d), 3, [1, 2, 3, 4, 5])


@query("kmeans_best_of_seeds")
def kmeans_best_of_seeds(spark, d):
    rows = _rows(spark, d)
    return kmeans.search_table(spark, kmeans.search(rows, range(2, 9), range(20))[1])


@query("gap_statistic")
def gap_statistic(spark, d):
    return kmeans.gap_statistic(_rows(spark, d), range(2, 9), references=5, steps=300)


@query("seed_stability")
def seed_stability(spark, d):
    rows = _rows(spark, d)
    fits = kmeans.lloyd(rows, kmeans.start(rows, [(3, s) for s in range(20)]))
    return agreement.pairwise_ari(kmeans.assign(rows, fits))


def _bootstrap(spark, d):
    rows = _rows(spark, d)
    draws = materialize(bootstrap_draws(rows.select("id"), 6, 42, "id"), "draws")
    return rows, draws, kmeans.bootstrap_fits(rows, draws, 3, 42, 20)


@query("bootstrap_stability")
def bootstrap_stability(spark, d):
    """Every resample's fit on fixed anchor rows, pair by pair."""
    rows, _, fits = _bootstrap(spark, d)
    return agreement.pairwise_ari(kmeans.assign(hash_sample(rows, 1500, 7, "id"), fits))


@query("bootstrap_jaccard")
def bootstrap_jaccard(spark, d):
    """Best match of each cluster of the full fit in each resample."""
    rows, draws, fits = _bootstrap(spark, d)
    reference = kmeans.assign(rows, kmeans.lloyd(rows, kmeans.start(rows, [(3, 42)]), 20)).select("id", "cluster")
    labels = kmeans.assign(rows, fits)
    drawn = draws.select("id", F.concat(F.lit("b"), F.col("run").cast("string")).alias("run_id"))
    return agreement.best_overlap(reference, labels.join(drawn, ["id", "run_id"], "left_semi"))


# hierarchies


@query("linkage_tree")
def linkage_tree(spark, d):
    return hierarchy.trees(_sample(spark, d, 2_000), ks=[2]).where("kind = 'merge'").select("linkage", "step", "left", "right", "height", "size")


@query("hierarchy_cut")
def hierarchy_cut(spark, d):
    return hierarchy.cuts_of(hierarchy.trees(_sample(spark, d, 2_000), ks=range(2, 9)))


@query("cophenetic")
def cophenetic(spark, d):
    return hierarchy.trees(_sample(spark, d, 2_000), ks=[2]).where("kind = 'cophenetic'").select("linkage", F.col("height").alias("correlation"))


_SQ = f"WITH RECURSIVE {fx.VECTORS}, sm AS (SELECT id, v FROM vec ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 2000), e AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM sm a, sm b WHERE a.id <> b.id), cut AS (SELECT quantile_cont(m, 0.25) AS h FROM (SELECT min(dist) AS m FROM e GROUP BY i)), reach AS (SELECT id, id AS r FROM sm UNION SELECT reach.id, e.j FROM reach JOIN e ON e.i = reach.r, cut WHERE dist <= h)"


@query("single_linkage_height_cut", f"{_SQ} SELECT id, min(r) AS root FROM reach GROUP BY id")
def single_linkage_height_cut(spark, d):
    """Components of the single-linkage tree below the lower quartile of nearest-neighbour distances."""
    rows = _sample(spark, d, 2_000)
    h = pairs.nearest(rows, rows, 1).agg(F.percentile("distance", 0.25)).collect()[0][0]
    merges = [r for r in hierarchy.trees(rows, ["single"], ks=[2]).where("kind = 'merge'").orderBy("step").collect() if r["height"] <= h]  # a sample's merges
    ids = sorted(r["id"] for r in rows.select("id").collect())
    members = {i: [x] for i, x in enumerate(ids)}
    for r in merges:
        members[len(ids) + r["step"] - 1] = members.pop(r["left"]) + members.pop(r["right"])
    return spark.createDataFrame([(x, min(own)) for own in members.values() for x in own], "id long, root long")


@query("metric_sensitivity")
def metric_sensitivity(spark, d):
    """Average linkage under two metrics: agreement of the cuts for each k."""
    return hierarchy.agreement_by_k(hierarchy.cuts_of(hierarchy.trees(_sample(spark, d, 2_500), ["average"], ("euclidean", "manhattan"), range(2, 6))))


@query("cut_strategies")
def cut_strategies(spark, d):
    """For each linkage the cut at the first share of the top height that leaves several clusters, and the cut of the best silhouette."""
    rows = _sample(spark, d, 2_000)
    built = materialize(hierarchy.trees(rows, ks=range(2, 9)), "trees")
    scores = metrics.silhouette_points(hierarchy.cuts_of(built).join(rows, "id")).groupBy("run_id").agg(F.avg("silhouette").alias("silhouette"))
    part = lambda i: F.get(F.split("run_id", "/"), F.lit(i))
    best = scores.groupBy(part(0).alias("linkage")).agg(F.max_by(part(2), "silhouette").cast("long").alias("silhouette_k"), F.max("silhouette").alias("silhouette"))
    fixed = built.where("kind = 'fixed'").select("linkage", F.col("step").alias("fixed_height_k"), F.col("height").alias("fixed_height"))
    return best.join(fixed, "linkage")


# DBSCAN

_KD = "kd AS (SELECT i, dist FROM dd QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) = 9)"
_DBS = f"""WITH RECURSIVE {fx.VECTORS}, dd AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM vec a, vec b WHERE a.id <> b.id), {_KD}, ep AS (SELECT quantile_cont(dist, 0.5) AS eps FROM kd),
core AS (SELECT id FROM vec LEFT JOIN (SELECT i, count(*) AS n FROM dd, ep WHERE dist <= eps GROUP BY i) c ON c.i = id WHERE coalesce(n, 0) + 1 >= 10),
ce AS (SELECT i, j FROM dd, ep WHERE dist <= eps AND i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, ce.j FROM reach JOIN ce ON ce.i = reach.r),
lab AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT id, min(r) AS root FROM reach GROUP BY id)),
bor AS (SELECT i AS id, min(cluster) AS cluster FROM dd JOIN lab ON lab.id = dd.j, ep WHERE dist <= eps AND i NOT IN (SELECT id FROM core) GROUP BY i)"""


@query("dbscan_labels", f"{_DBS} SELECT id, coalesce(lab.cluster, bor.cluster, -1) AS cluster, lab.cluster IS NOT NULL AS core FROM vec LEFT JOIN lab USING (id) LEFT JOIN bor USING (id)", longs="cluster")
def dbscan_labels(spark, d):
    rows = _rows(spark, d)
    return dbscan.dbscan(rows, dbscan.eps_grid(rows, 10, (0.5,))[0], 10)


def _dbscan_table(spark, d):
    rows = materialize(_rows(spark, d), "rows")
    found = materialize(dbscan.search(rows), "dbscan")
    return metrics.cluster_counts(found).join(metrics.internal(found.join(rows, "id")), "run_id", "left")


@query("dbscan_search")
def dbscan_search(spark, d):
    return _dbscan_table(spark, d)


@query("dbscan_choice")
def dbscan_choice(spark, d):
    return dbscan.choose(_dbscan_table(spark, d))


# mixtures


def _reduced(spark, d, kept=5):
    rows = _rows(spark, d)
    mean, loadings, _, _ = scaling.fit_pca(rows)
    return materialize(scaling.apply_pca(rows, mean, loadings, kept), "pca")


@query("gmm_search")
def gmm_search(spark, d):
    """Four covariance types, k from 2 to 8, the best of three starts each."""
    return mixture.search(_reduced(spark, d), steps=100, starts=3)[0]


@query(
    "gmm_bic_identity",
    "WITH m(covariance, k) AS (SELECT c, k FROM (SELECT unnest(['spherical', 'diag', 'tied', 'full']) AS c), (SELECT unnest([2, 3]) AS k)), p AS (SELECT covariance, k, CASE covariance WHEN 'full' THEN k * 15 WHEN 'tied' THEN 15 WHEN 'diag' THEN k * 5 ELSE k END + k * 5 + k - 1 AS p FROM m) SELECT covariance, k, p * (ln((SELECT count(*) FROM embeddings)) - 2) AS gap FROM p",
    doubles="gap",
    longs="k",
)
def gmm_bic_identity(spark, d):
    """BIC less AIC is the number of parameters times (ln n - 2)."""
    return mixture.search(_reduced(spark, d), (2, 3), steps=3)[0].select("covariance", "k", (F.col("bic") - F.col("aic")).alias("gap"))


@query("gmm_convergence")
def gmm_convergence(spark, d):
    return mixture.convergence(mixture.fit(_reduced(spark, d), 3, "diag", steps=15, tolerance=0.0), spark)


@query("gmm_labels")
def gmm_labels(spark, d):
    rows = _reduced(spark, d)
    return mixture.assign(rows, {"full/3": mixture.fit(rows, 3, "full", steps=15)})


# ensembles


def _ensemble(spark, d):
    rows = hash_sample(_reduced(spark, d, 20), SAMPLE, 42, "id")
    rows = materialize(rows, "sample")
    return rows, materialize(ensemble.base_clusterings(rows, ensemble.base_grid(width=20)), "bases")


@query("base_clusterings")
def base_clusterings(spark, d):
    return _ensemble(spark, d)[1].select("base_id", "algorithm", "dimension", "k", "seed", "covariance", "inertia", "bic", "converged", F.size(F.array_distinct("clusters")).alias("n_clusters"))


@query("consensus_labels")
def consensus_labels(spark, d):
    return ensemble.consensus(_ensemble(spark, d)[1])


@query("preprocessing_sensitivity")
def preprocessing_sensitivity(spark, d):
    """ARI between K-Means partitions of raw, standard, robust and component-space rows."""
    rows = _rows(spark, d)
    spaces = {"raw": rows, "standard": scaling.apply_scaler(rows, scaling.fit_standard(rows)), "robust": scaling.apply_scaler(rows, scaling.fit_robust(rows)), "pca": _reduced(spark, d, 20)}
    out = None
    for name, space in spaces.items():
        own = kmeans.assign(space, kmeans.lloyd(space, kmeans.start(space, [(3, 42)]), 20)).withColumn("run_id", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return agreement.pairwise_ari(materialize(out, "spaces"), every=True)
