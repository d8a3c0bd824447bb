"""Queries that complete the method: whole grids, the consensus against its bases, refits, prototypes, sensitivities."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cairn.functions.text import normalise_algorithm, parse_int, parse_parameter
from cairn.operators import agreement, dbscan, ensemble, hierarchy, interpret, kmeans, metrics, mixture, pairs, profiling, refit, scaling, selection
from cairn.operators.cleaning import bootstrap_draws, hash_sample
from cairn.plans import clusters, quality
from cairn.plans import fixtures as fx
from cairn.plans.registry import query
from cairn.runtime import materialize

#: Seeds and resamples of the published runs.
STARTS, SEEDS, RESAMPLES = 20, 20, 20


@query("kmeans_grid")
def kmeans_grid(spark, d):
    """k from 2 to 8, each from many starts drawn apart, every fit to its end: the best of each k."""
    rows = materialize(clusters._rows(spark, d), "rows")
    return kmeans.search_table(spark, kmeans.search(rows, range(2, 9), range(STARTS), apart=True)[1])


@query("seed_stability_mixtures")
def seed_stability_mixtures(spark, d):
    rows = clusters._reduced(spark, d)
    models = mixture.fit_many(rows, [(f"s{s}", "diag", 3, s) for s in range(SEEDS)])
    return agreement.pairwise_ari(mixture.assign(rows, models))


def _bootstrap_grid(spark, d):
    """Labels of anchor rows under the fits of all resamples and all k, and under the best full fit of each k."""
    ks = range(2, 9)
    rows = materialize(clusters._rows(spark, d), "rows")
    anchors = materialize(hash_sample(rows, 1500, 7, "id"), "anchors")
    draws = materialize(bootstrap_draws(rows.select("id"), RESAMPLES, 42, "id"), "draws")
    whole = kmeans.start_apart(rows, [(k, s) for k in ks for s in range(STARTS)])
    fits = kmeans.bootstrap_grid(rows, draws, [(k, r) for k in ks for r in range(RESAMPLES)], whole=whole)
    k_of = F.regexp_extract("run_id", "^k([0-9]+)", 1).cast("long")
    labels = materialize(kmeans.assign(anchors, fits).withColumn("k", k_of), "labels")
    reference = materialize(kmeans.assign(anchors, kmeans.best_of(whole, ks)).select("id", k_of.alias("k"), "cluster"), "reference")
    ari, jaccard = agreement.against_reference(labels, reference)
    return materialize(ari, "ari"), materialize(jaccard, "jaccard"), draws


@query("bootstrap_by_k")
def bootstrap_by_k(spark, d):
    """For each k the resamples' agreement with the full fit on anchor rows, and the best matches of its clusters."""
    ari, jaccard, _ = _bootstrap_grid(spark, d)
    return selection.stability_summary(ari, jaccard)


@query("bootstrap_runs")
def bootstrap_runs(spark, d):
    """(k, run, ari, mean_jaccard, minimum_jaccard, unique_records) of each resample against the full fit."""
    ari, jaccard, draws = _bootstrap_grid(spark, d)
    matched = jaccard.groupBy("run_id").agg(F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("minimum_jaccard"))
    drawn = draws.groupBy("run").agg(F.count("*").alias("unique_records"))
    run = F.regexp_extract("run_id", "b([0-9]+)$", 1).cast("int")
    return ari.join(matched, "run_id").withColumn("run", run).join(drawn, "run").select("k", "run", "ari", "mean_jaccard", "minimum_jaccard", "unique_records")


def _consensus(spark, d):
    rows, bases = clusters._ensemble(spark, d)
    labelled = materialize(rows.join(fx.vectors(spark, d).select("id", "label"), "id"), "labelled")
    cuts = materialize(ensemble.consensus(bases), "cuts")
    scored = metrics.evaluate(cuts.join(labelled, "id")).withColumn("requested_k", F.col("run_id").cast("long"))
    return bases, labelled, materialize(selection.rank_sum(scored, ties=[F.desc("silhouette"), F.col("requested_k")]), "search")


@query("base_evaluation")
def base_evaluation(spark, d):
    bases, labelled, _ = _consensus(spark, d)
    return ensemble.evaluate_bases(bases, labelled)


@query("consensus_search")
def consensus_search(spark, d):
    return _consensus(spark, d)[2].drop("run_id")


def _sides(spark, d):
    bases, labelled, search = _consensus(spark, d)
    return materialize(ensemble.evaluate_bases(bases, labelled), "evaluated"), search.where("final_order = 1")


@query("consensus_vs_best_base")
def consensus_vs_best_base(spark, d):
    return ensemble.against_best_base(*_sides(spark, d))


@query("consensus_deltas")
def consensus_deltas(spark, d):
    evaluated, chosen = _sides(spark, d)
    return selection.compare(ensemble.best_base(evaluated), chosen)


@query("winner_refit")
def winner_refit(spark, d):
    """The ranked winner of a result table fitted again from its parameter text on a common sample, and measured."""
    rows = materialize(hash_sample(fx.vectors(spark, d), clusters.SAMPLE, 42, "id"), "sample")
    table = spark.createDataFrame([("Agglomerative", "k=3, linkage=ward"), ("K-Means", "k=3, seed=1"), ("GMM", "k=3, covariance=diag")], "algorithm string, parameters string")
    own = table.select(normalise_algorithm(F.col("algorithm")).alias("algorithm"), parse_int(F.col("parameters"), "k").alias("k"), *(parse_parameter(F.col("parameters"), c).alias(c) for c in ("linkage", "seed", "covariance")))
    out = None
    for r in own.collect():  # a row for each algorithm
        made = refit.refit(rows.select("id", "v"), r["algorithm"], r["k"], linkage=r["linkage"], seed=r["seed"], covariance=r["covariance"])
        out = made if out is None else out.unionByName(made)
    return metrics.evaluate(materialize(out, "refits").join(rows, "id"))


@query("unified_portfolio")
def unified_portfolio(spark, d):
    """Results of seven kinds in the same columns: searches of each family, bases, consensus, refits."""
    rows = clusters._sample(spark, d, 2_000)
    measured = lambda labels: metrics.cluster_counts(labels).join(metrics.internal(labels.join(rows, "id")), "run_id", "left").withColumn("parameters", F.col("run_id")).drop("run_id")
    fits = kmeans.search(rows, (2, 3, 4), (1, 2))[1]
    bases, labelled, search = _consensus(spark, d)
    made = refit.refit(rows, "kmeans", 3, seed=1)
    return selection.unify(
        {
            "kmeans": measured(materialize(kmeans.assign(rows, fits), "kmeans")),
            "hierarchical": measured(materialize(hierarchy.cuts_of(hierarchy.trees(rows, ks=(2, 3))), "cuts")),
            "dbscan": measured(materialize(dbscan.search(rows, (10,), (0.9, 0.97)), "dbscan")),
            "gmm": mixture.search(clusters._reduced(spark, d), (2, 3), ("diag",), steps=10)[0],
            "bases": ensemble.evaluate_bases(bases, labelled),
            "consensus": search,
            "refit": measured(materialize(made, "refit")),
        }
    )


_MEDOID = f"{quality._DIST}, cc AS (SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM part WHERE run_id = 'a') GROUP BY ALL) GROUP BY cluster), own AS (SELECT id, cluster, n + 1 AS size, total, total / greatest(n, 1) AS m FROM sums WHERE other = cluster AND run_id = 'a'), md AS (SELECT cluster, arg_min(id, (round(total, 7), id)) AS id FROM own GROUP BY cluster), cl AS (SELECT p.cluster, arg_min(p.id, (round(list_distance(p.v, c), 9), p.id)) AS id FROM part p JOIN cc USING (cluster) WHERE p.run_id = 'a' GROUP BY p.cluster)"


@query(
    "medoid_diagnostics",
    f"{_MEDOID} SELECT md.cluster, a.size, md.id AS medoid_id, a.m AS medoid_mean, cl.id AS closest_id, b.m AS closest_mean, CASE WHEN b.m > 0 THEN (b.m - a.m) / b.m ELSE 0 END AS improvement FROM md JOIN own a ON a.id = md.id JOIN cl ON cl.cluster = md.cluster JOIN own b ON b.id = cl.id",
    doubles="medoid_mean closest_mean improvement",
    longs="size",
)
def medoid_diagnostics(spark, d):
    rows = materialize(quality._a(spark, d), "run")
    sums = materialize(pairs.label_sums(rows).join(rows.select("id", "run_id", "cluster"), ["id", "run_id"]).where("other = cluster"), "sums")
    closest = interpret.exemplars(quality._points(spark, d).withColumnRenamed("own", "distance")).where("kind = 'closest'")
    return interpret.medoid_diagnostics(metrics.medoids(rows), sums, closest)


@query(
    "enriched_prototypes",
    f"{quality._PTS}, ex AS (SELECT cluster, 'closest' AS kind, arg_min(id, (round(distance, 9), id)) AS id FROM pts GROUP BY cluster UNION ALL SELECT cluster, 'representative', arg_max(id, (round(silhouette, 9), -id)) FROM pts GROUP BY cluster UNION ALL SELECT cluster, 'boundary', arg_min(id, (round(silhouette, 9), id)) FROM pts GROUP BY cluster UNION ALL SELECT cluster, 'medoid', arg_min(id, (round(total, 7), id)) FROM sums WHERE other = cluster AND run_id = 'a' GROUP BY cluster) SELECT ex.cluster, ex.kind, ex.id, distance, silhouette, label, 'Cluster ' || CAST(ex.cluster AS VARCHAR) AS name FROM ex JOIN pts USING (id)",
    doubles="distance silhouette",
)
def enriched_prototypes(spark, d):
    points = quality._points(spark, d).withColumnRenamed("own", "distance")
    med = metrics.medoids(quality._a(spark, d)).select("cluster", F.lit("medoid").alias("kind"), "id")
    names = points.select("cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("name")).distinct()
    kinds = interpret.exemplars(points).drop("value").unionByName(med)
    return interpret.enrich_prototypes(kinds, points.select("cluster", "id", "distance", "silhouette", "label"), names)


@query(
    "ari_by_algorithm",
    f"{quality._ARI}, g(run_id, algorithm) AS (VALUES ('a', 'x'), ('b', 'x'), ('c', 'x'), ('d', 'y')) SELECT a.algorithm, count(*) AS pairs, avg(ari) AS ari_mean, stddev_samp(ari) AS ari_std, min(ari) AS ari_min, max(ari) AS ari_max FROM ag JOIN g a ON a.run_id = ag.\"left\" JOIN g b ON b.run_id = ag.\"right\" WHERE a.algorithm = b.algorithm AND ag.\"left\" < ag.\"right\" GROUP BY a.algorithm",
    doubles="ari_mean ari_std ari_min ari_max",
)
def ari_by_algorithm(spark, d):
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "run_id string, algorithm string")
    return agreement.ari_summary(quality._runs(spark, d), groups)


@query("preprocessing_measures")
def preprocessing_measures(spark, d):
    """Silhouette and inertia of K-Means in standard, robust and component space."""
    rows = materialize(clusters._rows(spark, d), "rows")
    spaces = {"standard": scaling.apply_scaler(rows, scaling.fit_standard(rows)), "robust": scaling.apply_scaler(rows, scaling.fit_robust(rows)), "pca": clusters._reduced(spark, d, 20)}

    def measured(name):
        space = materialize(spaces[name], "space")
        fit = kmeans.search(space, [3], range(STARTS), apart=True)[1][0]
        labels = kmeans.assign(space, [fit]).join(space, "id")
        return metrics.silhouette_points(labels).agg(F.avg("silhouette").alias("silhouette")).select(F.lit(name).alias("representation"), F.lit(fit.centers.shape[1]).cast("long").alias("n_features"), "silhouette", F.lit(fit.inertia[-1]).alias("inertia"))

    with ThreadPoolExecutor(len(spaces)) as pool:  # the jobs of the three fits side by side
        return reduce(DataFrame.unionByName, pool.map(measured, spaces))


@query("metric_sensitivity_silhouette")
def metric_sensitivity_silhouette(spark, d):
    """Silhouettes of average-linkage cuts, each under the metric that made it."""
    rows = clusters._sample(spark, d, 2_500)
    cuts = materialize(hierarchy.cuts_of(hierarchy.trees(rows, ["average"], ("euclidean", "manhattan"), range(2, 6))), "cuts")
    out = None
    for metric in ("euclidean", "manhattan"):
        own = metrics.silhouette_points(cuts.where(F.col("run_id").contains(f"/{metric}/")).join(rows, "id"), metric).groupBy("run_id").agg(F.avg("silhouette").alias("silhouette"))
        out = own if out is None else out.unionByName(own)
    return out.select(F.get(F.split("run_id", "/"), F.lit(1)).alias("metric"), F.get(F.split("run_id", "/"), F.lit(2)).cast("long").alias("k"), "silhouette")


@query("metric_sensitivity_both")
def metric_sensitivity_both(spark, d):
    """Silhouettes of average-linkage cuts under both metrics, whichever made them."""
    rows = clusters._sample(spark, d, 2_500)
    cuts = materialize(hierarchy.cuts_of(hierarchy.trees(rows, ["average"], ("euclidean", "manhattan"), range(2, 6))), "cuts")
    out = None
    for metric in ("euclidean", "manhattan"):
        own = metrics.silhouette_points(cuts.join(rows, "id"), metric).groupBy("run_id").agg(F.avg("silhouette").alias("silhouette")).withColumn("measured_by", F.lit(metric))
        out = own if out is None else out.unionByName(own)
    return out.select(F.get(F.split("run_id", "/"), F.lit(1)).alias("made_by"), "measured_by", F.get(F.split("run_id", "/"), F.lit(2)).cast("long").alias("k"), "silhouette")


@query("permutation_importance")
def permutation_importance(spark, d):
    names = list(fx.WIDE)
    rows = fx.lines(spark, d).withColumn("id", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    rows = materialize(rows.withColumn("cluster", F.when(F.col("l_quantity") * F.col("l_discount") > 1.5, 1).when(F.col("l_extendedprice") > 50_000, 2).otherwise(0)), "lines")
    model = interpret.surrogate_tree(rows, names)[0]
    split = interpret.importances(model, names, spark).withColumnRenamed("importance", "split_importance")
    return interpret.permutation_importance(model, rows, names).join(split, "feature")


_P_VALUE = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM lineitem" for a in fx.WIDE for b in fx.WIDE if a != b)


@query(
    "correlation_p_values",
    f"""WITH c AS ({_P_VALUE}), i AS (SELECT *, abs(r) AS lo, least(1.0, abs(r) + 40 / sqrt(n)) AS hi FROM c),
g AS (SELECT "left", "right", sum(CASE WHEN s IN (0, 4000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2) - lgamma(0.5) + (n - 4) / 2 * ln(1 - (lo + (hi - lo) * s / 4000) ** 2))) * any_value((hi - lo) / 4000 / 3) * 2 AS p FROM i, (SELECT unnest(range(4001)) AS s) GROUP BY ALL)
SELECT c."left", c."right", n, r, least(p, 1.0) AS p_value, p <= 0.01 AS significant, CASE WHEN p <= 0.01 THEN r END AS masked FROM c JOIN g USING ("left", "right")""",
    doubles="r p_value masked",
)
def correlation_p_values(spark, d):
    """p as the density of r, integrated by SQL; here as the incomplete beta function."""
    return profiling.correlation_significance(fx.lines(spark, d), fx.WIDE)
