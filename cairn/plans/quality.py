"""Queries over partitions of the embeddings: quality measures, agreement, tendency, interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import agreement, interpret, metrics, pairs, scaling, selection, tendency
from cairn.operators.cleaning import hash_sample
from cairn.plans import fixtures as fx
from cairn.plans.registry import query
from cairn.runtime import materialize

_P = f"WITH {fx.PARTITIONS}"
#: Distances of the labelled vectors, and silhouettes of every run.
_DIST = f"""{_P}, one AS (SELECT * FROM vec), dd AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM one a, one b WHERE a.id <> b.id),
sums AS (SELECT p.run_id, p.id, p.cluster, q.cluster AS other, count(*) AS n, sum(dist) AS total FROM dd JOIN part p ON p.id = dd.i JOIN part q ON q.id = dd.j AND q.run_id = p.run_id GROUP BY ALL),
ab AS (SELECT run_id, id, cluster, max(CASE WHEN other = cluster THEN total / n END) AS a, min(CASE WHEN other <> cluster THEN total / n END) AS b FROM sums GROUP BY ALL),
sil AS (SELECT run_id, id, cluster, a, b, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""
_CENT = f"""{_P}, x AS (SELECT run_id, cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM part), m AS (SELECT run_id, cluster, dim, avg(x) AS x FROM x GROUP BY ALL),
cent AS (SELECT run_id, cluster, list(x ORDER BY dim) AS c FROM m GROUP BY ALL), sc AS (SELECT run_id, cluster, avg(list_distance(v, c)) AS s, sum(list_distance(v, c) ** 2) AS w, count(*) AS n FROM part JOIN cent USING (run_id, cluster) GROUP BY ALL)"""


def _rows(spark, d):
    return fx.partitions(spark, d)


@query("silhouette_points", f"{_DIST} SELECT id, run_id, cluster, a, b, silhouette FROM sil", doubles="a b silhouette")
def silhouette_points(spark, d):
    return metrics.silhouette_points(_rows(spark, d))


@query(
    "silhouette_cluster_summary",
    f"{_DIST} SELECT run_id, cluster, count(*) AS size, avg(silhouette) AS mean, quantile_cont(silhouette, 0.5) AS median, min(silhouette) AS min, max(silhouette) AS max, avg(CASE WHEN silhouette < 0 THEN 1.0 ELSE 0.0 END) AS negative_fraction, avg(CASE WHEN abs(silhouette) <= 0.10 THEN 1.0 ELSE 0.0 END) AS boundary_fraction FROM sil GROUP BY ALL",
    doubles="mean median min max negative_fraction boundary_fraction",
)
def silhouette_cluster_summary(spark, d):
    return metrics.silhouette_summary(metrics.silhouette_points(_rows(spark, d)))


@query("silhouette", f"{_DIST} SELECT run_id, avg(silhouette) AS silhouette FROM sil GROUP BY run_id", doubles="silhouette")
def silhouette(spark, d):
    return metrics.silhouette_points(_rows(spark, d)).groupBy("run_id").agg(F.avg("silhouette").alias("silhouette"))


_DB = f"{_CENT}, dbi AS (SELECT run_id, avg(r) AS davies_bouldin FROM (SELECT a.run_id, a.cluster, max((a.s + b.s) / list_distance(ca.c, cb.c)) AS r FROM sc a JOIN sc b ON a.run_id = b.run_id AND a.cluster <> b.cluster JOIN cent ca ON ca.run_id = a.run_id AND ca.cluster = a.cluster JOIN cent cb ON cb.run_id = b.run_id AND cb.cluster = b.cluster GROUP BY ALL) GROUP BY run_id)"
_CH = """, gm AS (SELECT run_id, dim, avg(x) AS g FROM x GROUP BY ALL), bt AS (SELECT m.run_id, sum(sc.n * (m.x - g) ** 2) AS b FROM m JOIN gm USING (run_id, dim) JOIN sc USING (run_id, cluster) GROUP BY m.run_id),
chi AS (SELECT run_id, (b / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS calinski_harabasz FROM sc JOIN bt USING (run_id) GROUP BY run_id, b)"""


@query("davies_bouldin", f"{_DB} SELECT run_id, davies_bouldin FROM dbi", doubles="davies_bouldin")
def davies_bouldin(spark, d):
    return metrics.davies_bouldin(_rows(spark, d))


@query("calinski_harabasz", f"{_CENT}{_CH} SELECT run_id, calinski_harabasz FROM chi", doubles="calinski_harabasz")
def calinski_harabasz(spark, d):
    return metrics.calinski_harabasz(_rows(spark, d))


@query("contingency", f"{_P} SELECT run_id, cluster, label, count(*) AS n FROM part GROUP BY ALL")
def contingency(spark, d):
    return metrics.contingency(_rows(spark, d))


_EXT = f"""{_P}, t AS (SELECT run_id, cluster, label, count(*) AS n FROM part GROUP BY ALL),
A AS (SELECT run_id, cluster, sum(n) AS a, max(n) AS top FROM t GROUP BY ALL), B AS (SELECT run_id, label, sum(n) AS b FROM t GROUP BY ALL), N AS (SELECT run_id, sum(n) AS nn FROM t GROUP BY ALL),
tk AS (SELECT run_id, sum(n * (n - 1) / 2) AS tk FROM t GROUP BY ALL), pk AS (SELECT run_id, sum(a * (a - 1) / 2) AS pk, sum(top) AS top FROM A GROUP BY ALL), qk AS (SELECT run_id, sum(b * (b - 1) / 2) AS qk FROM B GROUP BY ALL),
hk AS (SELECT run_id, -sum(a / nn * ln(a / nn)) AS hk FROM A JOIN N USING (run_id) GROUP BY ALL), hc AS (SELECT run_id, -sum(b / nn * ln(b / nn)) AS hc FROM B JOIN N USING (run_id) GROUP BY ALL),
mi AS (SELECT run_id, sum(n / nn * ln(n * nn / (a * b))) AS mi FROM t JOIN A USING (run_id, cluster) JOIN B USING (run_id, label) JOIN N USING (run_id) GROUP BY ALL),
ext AS (SELECT run_id, top / nn AS purity, (tk - pk * qk / (nn * (nn - 1) / 2)) / ((pk + qk) / 2 - pk * qk / (nn * (nn - 1) / 2)) AS ari, 2 * mi / (hk + hc) AS nmi, tk / sqrt(pk * qk) AS fowlkes_mallows, mi / hc AS homogeneity, mi / hk AS completeness, 2 * mi / (hk + hc) AS v_measure
FROM tk JOIN pk USING (run_id) JOIN qk USING (run_id) JOIN N USING (run_id) JOIN hk USING (run_id) JOIN hc USING (run_id) JOIN mi USING (run_id))"""


def _external(name: str, *columns: str):
    @query(name, f"{_EXT} SELECT run_id, {', '.join(columns)} FROM ext", doubles=" ".join(columns))
    def own(spark, d):
        return metrics.external(_rows(spark, d), ami=False).select("run_id", *columns)


_external("purity", "purity")
_external("ari", "ari")
_external("nmi", "nmi")
_external("fowlkes_mallows", "fowlkes_mallows")
_external("homogeneity_completeness_v", "homogeneity", "completeness", "v_measure")


@query("ami")
def ami(spark, d):
    return metrics.external(_rows(spark, d)).select("run_id", "ami")


@query("evaluation_rows")
def evaluation_rows(spark, d):
    return metrics.evaluate(_rows(spark, d))


@query("cluster_sizes", f"{_P}, s AS (SELECT run_id, cluster, count(*) AS n FROM part GROUP BY ALL) SELECT run_id, count(*) AS k, min(n) AS min_size, max(n) AS max_size, quantile_cont(n, 0.5) AS median_size, min(n) / sum(n) AS smallest_fraction, max(n) / sum(n) AS largest_fraction FROM s GROUP BY run_id", doubles="median_size smallest_fraction largest_fraction")
def cluster_sizes(spark, d):
    return metrics.size_statistics(_rows(spark, d))


@query("cluster_counts", f"{_P} SELECT run_id, count(*) AS n_records, count(DISTINCT CASE WHEN c >= 0 THEN c END) AS n_clusters, avg(CASE WHEN c < 0 THEN 1.0 ELSE 0.0 END) AS noise_fraction FROM (SELECT run_id, CASE WHEN id % 10 = 3 THEN -1 ELSE cluster END AS c FROM part) GROUP BY run_id", doubles="noise_fraction")
def cluster_counts(spark, d):
    return metrics.cluster_counts(_rows(spark, d).withColumn("cluster", F.when(F.col("id") % 10 == 3, -1).otherwise(F.col("cluster"))))


@query("medoids", f"{_DIST}, own AS (SELECT * FROM sums WHERE other = cluster) SELECT run_id, cluster, arg_min(id, (round(total, 7), id)) AS id, min(total) AS total, min(total / greatest(n, 1)) AS mean FROM own GROUP BY ALL", doubles="total mean")
def medoids(spark, d):
    return metrics.medoids(_rows(spark, d))


# agreement

_ARI = f"""{_P}, pp AS (SELECT a.run_id AS l, b.run_id AS r, a.cluster AS x, b.cluster AS y, count(*) AS n FROM part a JOIN part b USING (id) GROUP BY ALL),
tk AS (SELECT l, r, sum(n * (n - 1) / 2) AS tk, sum(n) AS nn FROM pp GROUP BY ALL), pk AS (SELECT l, r, sum(a * (a - 1) / 2) AS pk FROM (SELECT l, r, x, sum(n) AS a FROM pp GROUP BY ALL) GROUP BY ALL), qk AS (SELECT l, r, sum(b * (b - 1) / 2) AS qk FROM (SELECT l, r, y, sum(n) AS b FROM pp GROUP BY ALL) GROUP BY ALL),
ag AS (SELECT l AS "left", r AS "right", (tk - pk * qk / (nn * (nn - 1) / 2)) / ((pk + qk) / 2 - pk * qk / (nn * (nn - 1) / 2)) AS ari FROM tk JOIN pk USING (l, r) JOIN qk USING (l, r))"""


def _runs(spark, d):
    return _rows(spark, d).select("id", "run_id", "cluster")


@query("agreement_matrix", f'{_ARI} SELECT "left", "right", ari FROM ag', doubles="ari")
def agreement_matrix(spark, d):
    return agreement.pairwise_ari(_runs(spark, d), every=True)


@query("pairwise_run_ari", f'{_ARI} SELECT "left", "right", ari FROM ag WHERE "left" < "right"', doubles="ari")
def pairwise_run_ari(spark, d):
    return agreement.pairwise_ari(_runs(spark, d))


@query("agreement_summary", f'{_ARI} SELECT avg(ari) AS mean, min(ari) AS min, max(ari) AS max FROM ag WHERE "left" <> "right"', doubles="mean min max")
def agreement_summary(spark, d):
    return agreement.off_diagonal(agreement.pairwise_ari(_runs(spark, d), every=True))


_JAC = f"""{_P}, c AS (SELECT b.run_id, a.cluster AS c, b.cluster AS m, count(*) AS n FROM part a JOIN part b USING (id) WHERE a.run_id = 'a' AND b.run_id <> 'a' GROUP BY ALL),
na AS (SELECT cluster AS c, count(*) AS na FROM part WHERE run_id = 'a' GROUP BY ALL), nb AS (SELECT run_id, cluster AS m, count(*) AS nb FROM part GROUP BY ALL),
jj AS (SELECT run_id, c AS cluster, arg_max(m, (n / (na + nb - n), -m)) AS match, max(n / (na + nb - n)) AS jaccard FROM c JOIN na USING (c) JOIN nb USING (run_id, m) GROUP BY ALL)"""


@query("jaccard_match", f"{_JAC} SELECT run_id, cluster, match, jaccard FROM jj", doubles="jaccard")
def jaccard_match(spark, d):
    runs = materialize(_runs(spark, d), "runs")
    return agreement.best_overlap(runs.where("run_id = 'a'").select("id", "cluster"), runs.where("run_id <> 'a'"))


@query("coassociation", f"{_P} SELECT a.id AS i, b.id AS j, count(*) FILTER (a.cluster = b.cluster) / 4 AS share FROM part a JOIN part b ON a.run_id = b.run_id AND a.id < b.id GROUP BY ALL", doubles="share")
def coassociation(spark, d):
    return agreement.coassociation(_runs(spark, d))


_HELD = "part WHERE (id + ascii(run_id)) % 3 <> 0"


@query("coclustering", f"{_P}, h AS (SELECT * FROM {_HELD}) SELECT a.id AS i, b.id AS j, count(*) FILTER (a.cluster = b.cluster) / count(*) AS probability FROM h a JOIN h b ON a.run_id = b.run_id AND a.id < b.id GROUP BY ALL", doubles="probability")
def coclustering(spark, d):
    return agreement.coclustering(_runs(spark, d).where("(id + ascii(run_id)) % 3 <> 0"))


@query(
    "coclustering_diagnostics",
    f"""{_P}, h AS (SELECT * FROM {_HELD}), pr AS (SELECT a.id AS i, b.id AS j, count(*) FILTER (a.cluster = b.cluster) / count(*) AS p FROM h a JOIN h b ON a.run_id = b.run_id AND a.id < b.id GROUP BY ALL),
k AS (SELECT id, cluster FROM part WHERE run_id = 'a'), w AS (SELECT p, x.cluster = y.cluster AS s FROM pr JOIN k x ON x.id = i JOIN k y ON y.id = j)
SELECT """ + ", ".join(f"{f} FILTER ({c}) AS {n}_{m}" for n, c in (("within", "s"), ("between", "NOT s")) for m, f in (("mean", "avg(p)"), ("median", "quantile_cont(p, 0.5)"), ("min", "min(p)"), ("max", "max(p)"))) + ", avg(p) FILTER (s) - avg(p) FILTER (NOT s) AS separation FROM w",
    doubles="within_mean within_median within_min within_max between_mean between_median between_min between_max separation",
)
def coclustering_diagnostics(spark, d):
    runs = materialize(_runs(spark, d), "runs")
    return agreement.coclustering_diagnostics(runs.where("(id + ascii(run_id)) % 3 <> 0"), runs.where("run_id = 'a'"))


@query(
    "k_stability_summary",
    f"""{_ARI}, {_JAC.removeprefix(_P + ', ')}, runs(run_id, k) AS (VALUES ('b', 3), ('c', 4), ('d', 5)),
aa AS (SELECT k, ari FROM ag JOIN runs ON "right" = run_id WHERE "left" = 'a'), jk AS (SELECT k, cluster, jaccard FROM jj JOIN runs USING (run_id)),
wc AS (SELECT k, min(m) AS worst_cluster_jaccard, max(m) AS best_cluster_jaccard FROM (SELECT k, cluster, avg(jaccard) AS m FROM jk GROUP BY ALL) GROUP BY k)
SELECT k, count(*) AS runs, avg(ari) AS ari_mean, stddev_samp(ari) AS ari_std, min(ari) AS ari_min, max(ari) AS ari_max, jaccard_mean, jaccard_min, worst_cluster_jaccard, best_cluster_jaccard FROM aa JOIN (SELECT k, avg(jaccard) AS jaccard_mean, min(jaccard) AS jaccard_min FROM jk GROUP BY k) USING (k) JOIN wc USING (k) GROUP BY ALL""",
    doubles="ari_mean ari_std ari_min ari_max jaccard_mean jaccard_min worst_cluster_jaccard best_cluster_jaccard",
    longs="k",
)
def k_stability_summary(spark, d):
    runs = materialize(_runs(spark, d), "runs")
    k = F.when(F.col("r") == "b", 3).when(F.col("r") == "c", 4).otherwise(5)
    ari = agreement.pairwise_ari(runs).where("left = 'a'").withColumn("r", F.col("right")).select(k.alias("k"), "ari")
    jac = agreement.best_overlap(runs.where("run_id = 'a'").select("id", "cluster"), runs.where("run_id <> 'a'")).withColumn("r", F.col("run_id")).select(k.alias("k"), "cluster", "jaccard")
    return selection.stability_summary(ari, jac)


# pairs and tendency

_VEC = f"WITH {fx.VECTORS}, dd AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM vec a, vec b WHERE a.id <> b.id)"


@query("knn", f"{_VEC} SELECT i AS id, row_number() OVER (PARTITION BY i ORDER BY round(dist, 9), j) AS rank, j AS other, dist AS distance FROM dd QUALIFY rank <= 6", doubles="distance")
def knn(spark, d):
    v = fx.vectors(spark, d).select("id", "v")
    return pairs.nearest(v, v, 6)


@query("knn_k_distance", f"{_VEC} SELECT i AS id, dist AS distance FROM dd QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) = 9", doubles="distance")
def knn_k_distance(spark, d):
    return pairs.k_distance(fx.vectors(spark, d).select("id", "v"), 10)


def _diagnostic(metric: str, distance: str) -> str:
    return f"SELECT '{metric}' AS metric, rank, avg(dist) AS mean, quantile_cont(dist, 0.5) AS median, quantile_cont(dist, 0.95) AS q95 FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM (SELECT a.id AS i, b.id AS j, {distance} AS dist FROM vec a, vec b WHERE a.id <> b.id)) WHERE rank IN (1, 5) GROUP BY rank"


@query("distance_metric_diagnostics", f"WITH {fx.VECTORS} {_diagnostic('euclidean', 'list_distance(a.v, b.v)')} UNION ALL {_diagnostic('manhattan', 'list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))')}", doubles="mean median q95")
def distance_metric_diagnostics(spark, d):
    return pairs.metric_diagnostics(fx.vectors(spark, d).select("id", "v"))


@query("mahalanobis_diagnostics")
def mahalanobis_diagnostics(spark, d):
    return pairs.metric_diagnostics(pairs.whiten(fx.vectors(spark, d).select("id", "v")), ("euclidean",)).withColumn("metric", F.lit("mahalanobis"))


_HOP = lambda seed: f"""x AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec), bx AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY dim),
u AS (SELECT p AS id, list(lo + (hi - lo) * (CAST('0x' || substr(md5('u{seed}:' || CAST(p AS VARCHAR) || ':' || CAST(dim AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0) ORDER BY dim) AS v FROM (SELECT unnest(range(50)) AS p), bx GROUP BY p),
w AS (SELECT id, v FROM vec ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id LIMIT 50),
lu AS (SELECT 64 * ln(min(list_distance(u.v, vec.v))) AS x FROM u, vec GROUP BY u.id), lw AS (SELECT 64 * ln(min(list_distance(w.v, vec.v))) AS x FROM w, vec WHERE w.id <> vec.id GROUP BY w.id),
su AS (SELECT m + ln(sum(exp(x - m))) AS l FROM lu, (SELECT max(x) AS m FROM lu) GROUP BY m), sw AS (SELECT m + ln(sum(exp(x - m))) AS l FROM lw, (SELECT max(x) AS m FROM lw) GROUP BY m)"""  # noqa: E731


@query("hopkins", f"WITH {fx.VECTORS}, {_HOP(42)} SELECT CAST(42 AS BIGINT) AS seed, CAST(50 AS BIGINT) AS m, CAST(64 AS BIGINT) AS dimension, 1 / (1 + exp(-(su.l - sw.l))) AS hopkins FROM su, sw", doubles="hopkins")
def hopkins(spark, d):
    return tendency.hopkins(fx.vectors(spark, d).select("id", "v"), 50)


@query("hopkins_500")
def hopkins_500(spark, d):
    """As many probes as the reference; ``hopkins`` has the 50 of its SQL."""
    return tendency.hopkins(fx.vectors(spark, d).select("id", "v"), 500)


@query("repeated_hopkins_summary")
def repeated_hopkins_summary(spark, d):
    return tendency.hopkins_summary(tendency.repeated_hopkins(fx.vectors(spark, d).select("id", "v"), 500, 5).withColumn("scaler", F.lit("none")))


@query("hopkins_by_scaler")
def hopkins_by_scaler(spark, d):
    """Five repetitions of 500 probes in standard and in robust space."""
    rows = fx.vectors(spark, d).select("id", "v")
    spaces = {"standard": scaling.apply_scaler(rows, scaling.fit_standard(rows)), "robust": scaling.apply_scaler(rows, scaling.fit_robust(rows))}
    runs = None
    for name, space in spaces.items():
        own = tendency.repeated_hopkins(materialize(space, "space"), 500, 5).withColumn("scaler", F.lit(name))
        runs = own if runs is None else runs.unionByName(own)
    return tendency.hopkins_summary(runs)


@query("vat_order")
def vat_order(spark, d):
    return tendency.vat_edges(hash_sample(fx.vectors(spark, d).select("id", "v"), 400, 42, "id"))


@query("mst_total_weight", f"""WITH RECURSIVE {fx.VECTORS}, s AS (SELECT id, v, row_number() OVER (ORDER BY id) AS r FROM (SELECT id, v FROM vec ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 12)),
e AS (SELECT a.r AS i, b.r AS j, list_distance(a.v, b.v) AS w FROM s a, s b WHERE a.r <> b.r),
grow AS (SELECT [CAST(1 AS BIGINT)] AS inside, CAST(0 AS DOUBLE) AS total UNION ALL SELECT list_append(inside, q.p.j), total + q.p.w FROM (SELECT inside, total, (SELECT {{'w': w, 'j': j}} FROM e WHERE list_contains(inside, e.i) AND NOT list_contains(inside, e.j) ORDER BY w, j LIMIT 1) AS p FROM grow WHERE len(inside) < 12) q)
SELECT max(total) AS total_weight FROM grow""", doubles="total_weight")
def mst_total_weight(spark, d):
    sample = hash_sample(fx.vectors(spark, d).select("id", "v"), 12, 42, "id")
    return tendency.vat_edges(sample).agg(F.sum("weight").alias("total_weight"))


@query("mst_total_weight_all")
def mst_total_weight_all(spark, d):
    """The tree of all rows; ``mst_total_weight`` takes the twelve that SQL can follow."""
    return tendency.spanning_tree(fx.vectors(spark, d).select("id", "v")).agg(F.sum("weight").alias("total_weight"))


# interpretation of run a

_LONG = f"{_P}, lg AS (SELECT cluster, 'd' || CAST(dim AS VARCHAR) AS feature, x AS value FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM part WHERE run_id = 'a')), pf AS (SELECT cluster, feature, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, (avg(value) - any_value(mu)) / any_value(sd) AS z FROM lg JOIN (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM lg GROUP BY feature) USING (feature) GROUP BY ALL)"


def _a(spark, d):
    return _rows(spark, d).where("run_id = 'a'")


def _profile(spark, d):
    long = _a(spark, d).select("cluster", F.posexplode("v").alias("dim", "value"))
    return interpret.profiles(long.select("cluster", F.concat(F.lit("d"), F.col("dim").cast("string")).alias("feature"), "value"))


@query("cluster_profiles", f"{_LONG} SELECT * FROM pf", doubles="mean median z")
def cluster_profiles(spark, d):
    return _profile(spark, d)


@query("profile_heatmap_features", f"{_LONG} SELECT row_number() OVER (ORDER BY max(abs(z)) DESC, feature) AS position, feature, max(abs(z)) AS strength FROM pf GROUP BY feature QUALIFY position <= 15", doubles="strength")
def profile_heatmap_features(spark, d):
    return interpret.top_features(_profile(spark, d))


@query("domain_labels", f"{_LONG}, r AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature) AS r, CASE WHEN z >= 0 THEN 'high ' ELSE 'low ' END || feature AS word FROM pf QUALIFY r <= 5) SELECT cluster, 'Cluster ' || CAST(cluster AS VARCHAR) || ': ' || string_agg(word, ', ' ORDER BY r) AS label FROM r GROUP BY cluster")
def domain_labels(spark, d):
    return interpret.domain_labels(_profile(spark, d))


@query("label_composition", f"{_P}, q AS (SELECT cluster, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM part WHERE run_id = 'a') SELECT cluster, count(*) AS size, sum(y) AS positives, avg(y) AS rate, (SELECT avg(y) FROM q) AS global_rate, avg(y) / (SELECT avg(y) FROM q) AS lift FROM q GROUP BY cluster", doubles="rate global_rate lift", longs="positives")
def label_composition(spark, d):
    return interpret.composition(_a(spark, d).select("cluster", F.when(F.col("label") == 0, 1).otherwise(0).alias("label")))


_PTS = f"{_DIST}, cc AS (SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM part WHERE run_id = 'a') GROUP BY ALL) GROUP BY cluster), pts AS (SELECT p.id, p.cluster, p.label, list_distance(p.v, c) AS distance, silhouette FROM part p JOIN cc USING (cluster) JOIN sil s ON s.id = p.id AND s.run_id = 'a' WHERE p.run_id = 'a')"


def _points(spark, d):
    rows = materialize(_a(spark, d), "run")
    cents = metrics.centroids(rows).select("cluster", "c")
    margin = interpret.centroid_margin(rows.select("id", "v", "cluster"), cents)
    sil = metrics.silhouette_points(rows).select("id", "silhouette")
    return materialize(margin.join(sil, "id").join(rows.select("id", "label"), "id"), "points")


@query(
    "exemplars",
    f"{_PTS} SELECT cluster, 'closest' AS kind, arg_min(id, (round(distance, 9), id)) AS id, min(distance) AS value FROM pts GROUP BY cluster UNION ALL SELECT cluster, 'representative', arg_max(id, (round(silhouette, 9), -id)), max(silhouette) FROM pts GROUP BY cluster UNION ALL SELECT cluster, 'boundary', arg_min(id, (round(silhouette, 9), id)), min(silhouette) FROM pts GROUP BY cluster",
    doubles="value",
)
def exemplars(spark, d):
    return interpret.exemplars(_points(spark, d).withColumnRenamed("own", "distance"))


@query("prototypes")
def prototypes(spark, d):
    points = _points(spark, d)
    med = metrics.medoids(_a(spark, d)).select("cluster", F.lit("medoid").alias("kind"), "id", F.col("mean").alias("value"))
    return interpret.exemplars(points.withColumnRenamed("own", "distance")).unionByName(med)


@query("prototype_check", "SELECT CAST(c AS BIGINT) AS cluster, TRUE AS complete FROM (SELECT unnest([0, 1, 2]) AS c)")
def prototype_check(spark, d):
    return interpret.check_prototypes(prototypes(spark, d))


@query(
    "centroid_margin",
    f"{_PTS}, m AS (SELECT p.id, p.cluster, cc.cluster AS o, list_distance(p.v, cc.c) AS dist FROM part p, cc WHERE p.run_id = 'a') SELECT id, cluster, min(dist) FILTER (o = cluster) AS own, arg_min(o, dist) FILTER (o <> cluster) AS other, min(dist) FILTER (o <> cluster) AS other_distance, min(dist) FILTER (o <> cluster) - min(dist) FILTER (o = cluster) AS margin FROM m GROUP BY id, cluster",
    doubles="own other_distance margin",
)
def centroid_margin(spark, d):
    return _points(spark, d).drop("silhouette", "label")


_LOW = f"{_PTS}, low AS (SELECT id, cluster, silhouette, CASE WHEN silhouette < 0 THEN 'probable_misassignment' WHEN silhouette <= 0.10 THEN 'boundary_case' ELSE 'weakly_separated' END AS category, label FROM pts ORDER BY silhouette, id LIMIT 100)"


@query("lowest_silhouette", f"{_LOW} SELECT id, cluster, silhouette, category FROM low", doubles="silhouette")
def lowest_silhouette(spark, d):
    return interpret.lowest_silhouettes(_points(spark, d))


@query("error_summary", f"{_LOW} SELECT category, count(*) AS n, min(silhouette) AS min, avg(silhouette) AS mean, avg(label) AS label_rate FROM low GROUP BY category", doubles="min mean label_rate")
def error_summary(spark, d):
    points = _points(spark, d)
    return interpret.error_summary(interpret.lowest_silhouettes(points), points.select("id", "label"))


@query(
    "error_report",
    f"{_LOW}, f AS (SELECT low.*, distance AS amount FROM low JOIN pts USING (id)) SELECT count(*) AS n, min(silhouette) AS min_silhouette, avg(silhouette) AS mean_silhouette, count(*) FILTER (silhouette < 0) AS n_negative, avg(CASE WHEN silhouette < 0 THEN 1.0 ELSE 0 END) AS negative_fraction, count(*) FILTER (abs(silhouette) <= 0.10) AS n_boundary, avg(CASE WHEN abs(silhouette) <= 0.10 THEN 1.0 ELSE 0 END) AS boundary_fraction, avg(label) AS label_rate, avg(amount) AS amount_mean, quantile_cont(amount, 0.5) AS amount_median FROM f",
    doubles="min_silhouette mean_silhouette negative_fraction boundary_fraction label_rate amount_mean amount_median",
)
def error_report(spark, d):
    """The distance to the own centroid is the amount."""
    points = _points(spark, d)
    return interpret.error_report(interpret.lowest_silhouettes(points), points.select("id", "label", F.col("own").alias("amount")))


@query("error_counts", f"{_LOW} SELECT cluster, category, count(*) AS n FROM low GROUP BY ALL")
def error_counts(spark, d):
    return interpret.error_counts(interpret.lowest_silhouettes(_points(spark, d)))


_ANO = f"{_PTS}, md AS (SELECT cluster, quantile_cont(distance, 0.5) AS med FROM pts GROUP BY cluster), ma AS (SELECT cluster, quantile_cont(abs(distance - med), 0.5) AS mad FROM pts JOIN md USING (cluster) GROUP BY cluster), an AS (SELECT cluster, id, label, distance, (distance - med) / greatest(mad * 1.4826, 2.220446049250313e-16) AS score FROM pts JOIN md USING (cluster) JOIN ma USING (cluster)), ar AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS anomaly_rank FROM an)"


def _ranked(spark, d):
    points = _points(spark, d)
    return points, interpret.anomalies(points.select("cluster", "id", F.col("own").alias("distance")))


@query("anomaly_ranking", f"{_ANO} SELECT cluster, id, distance, score, anomaly_rank FROM ar", doubles="distance score")
def anomaly_ranking(spark, d):
    return _ranked(spark, d)[1]


@query("anomaly_summary", f"{_ANO}, cut AS (SELECT quantile_cont(score, 0.99) AS threshold FROM ar), y AS (SELECT *, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM ar, cut) SELECT any_value(threshold) AS threshold, count(*) FILTER (score >= threshold) AS n_flagged, avg(y) AS rate_all, avg(y) FILTER (anomaly_rank <= 100) AS rate_top, avg(y) FILTER (score >= threshold) AS rate_flagged FROM y", doubles="threshold rate_all rate_top rate_flagged")
def anomaly_summary(spark, d):
    points, ranked = _ranked(spark, d)
    return interpret.anomaly_summary(ranked, points.select("id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label")))
