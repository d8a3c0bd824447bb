"""Queries that choose, compare, parse result tables, assign new rows, and serve streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.vectors import as_doubles
from cairn.operators import agreement, interpret, metrics, pairs, scaling, selection, serving
from cairn.operators.cleaning import temporal_split
from cairn.plans import fixtures as fx
from cairn.plans.quality import _CH, _DB, _DIST, _EXT
from cairn.plans.registry import query
from cairn.runtime import materialize

#: A result row for each part: parameters as text, names in many spellings, k in several columns.
PARTS = """pt AS (SELECT p_partkey AS id, 'k=' || CAST(p_size AS VARCHAR) || ', Linkage = ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ',eps=' || CAST(p_partkey % 10 AS VARCHAR) || '.5' ELSE '' END AS parameters,
CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 END AS k, CASE WHEN p_partkey % 4 = 1 THEN p_size + 2 END AS requested_k, CASE WHEN p_partkey % 4 = 2 THEN p_size + 3 END AS n_clusters,
CASE p_partkey % 7 WHEN 0 THEN ' K-Means ' WHEN 1 THEN 'Agglomerative (ward)' WHEN 2 THEN 'DBSCAN' WHEN 3 THEN 'GMM full' WHEN 4 THEN 'Gaussian Mixture' WHEN 5 THEN 'MiniBatchKMeans' ELSE 'Spectral ' END AS algorithm, p_retailprice AS price FROM part)"""


def _parts(spark, d):
    p = fx.table(spark, d, "part")
    at = lambda n, r: F.col("p_partkey") % n == r
    names = [" K-Means ", "Agglomerative (ward)", "DBSCAN", "GMM full", "Gaussian Mixture", "MiniBatchKMeans", "Spectral "]
    name = F.lit(names[-1])
    for i, n in enumerate(names[:-1]):
        name = F.when(at(7, i), n).otherwise(name)
    eps = F.when(at(3, 0), F.concat(F.lit(",eps="), (F.col("p_partkey") % 10).cast("string"), F.lit(".5"))).otherwise("")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("k="), F.col("p_size").cast("string"), F.lit(", Linkage = "), "p_brand", eps).alias("parameters"),
        F.when(at(4, 0), F.col("p_size") + 1).alias("k"),
        F.when(at(4, 1), F.col("p_size") + 2).alias("requested_k"),
        F.when(at(4, 2), F.col("p_size") + 3).alias("n_clusters"),
        name.alias("algorithm"),
        F.col("p_retailprice").alias("price"),
    )


@query(
    "param_parse",
    f"WITH {PARTS} SELECT id, CAST(regexp_extract(parameters, '(?i)(?:^|,)\\s*k\\s*=\\s*([^,]+)', 1) AS BIGINT) AS k, trim(regexp_extract(parameters, '(?i)(?:^|,)\\s*linkage\\s*=\\s*([^,]+)', 1)) AS linkage, TRY_CAST(nullif(regexp_extract(parameters, '(?i)(?:^|,)\\s*eps\\s*=\\s*([^,]+)', 1), '') AS DOUBLE) AS eps FROM pt",
    doubles="eps",
)
def param_parse(spark, d):
    p = _parts(spark, d)
    return p.select("id", text.parse_int(F.col("parameters"), "k").alias("k"), text.parse_parameter(F.col("parameters"), "linkage").alias("linkage"), text.parse_float(F.col("parameters"), "eps").alias("eps"))


@query("detect_k", f"WITH {PARTS} SELECT id, coalesce(k, requested_k, n_clusters, CAST(regexp_extract(parameters, 'k=([0-9]+)', 1) AS BIGINT)) AS k FROM pt", longs="k")
def detect_k(spark, d):
    c = F.col
    return _parts(spark, d).select("id", text.detect_k(c("k"), c("requested_k"), c("n_clusters"), F.lit(None), c("parameters")).alias("k"))


@query(
    "algorithm_names",
    f"WITH {PARTS}, l AS (SELECT id, lower(trim(algorithm)) AS a FROM pt) SELECT id, CASE WHEN a LIKE '%kmeans%' OR a LIKE '%k-means%' OR a LIKE '%k\\_means%' ESCAPE '\\' THEN 'kmeans' WHEN a LIKE '%hierarch%' OR a LIKE '%agglom%' OR a LIKE '%ward%' THEN 'hierarchical' WHEN a LIKE '%dbscan%' THEN 'dbscan' WHEN a LIKE '%gmm%' OR a LIKE '%gaussian%' OR a LIKE '%mixture%' THEN 'gmm' ELSE a END AS algorithm FROM l",
)
def algorithm_names(spark, d):
    return _parts(spark, d).select("id", text.normalise_algorithm(F.col("algorithm")).alias("algorithm"))


@query(
    "category_buckets",
    """SELECT event_id AS id, CASE WHEN v >= 0.90 THEN 'very high' WHEN v >= 0.75 THEN 'high' WHEN v >= 0.50 THEN 'moderate' ELSE 'low' END AS stability,
CASE WHEN v >= 0.70 THEN 'strong' WHEN v >= 0.50 THEN 'reasonable' WHEN v >= 0.25 THEN 'weak' ELSE 'none' END AS structure, CASE WHEN v >= 0.90 THEN 'low' WHEN v >= 0.70 THEN 'moderate' ELSE 'high' END AS sensitivity
FROM (SELECT event_id, value / 100 - 0.1 AS v FROM events)""",
)
def category_buckets(spark, d):
    v = F.col("value") / 100 - 0.1
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), text.stability_class(v).alias("stability"), text.silhouette_class(v).alias("structure"), text.sensitivity_class(v).alias("sensitivity"))


#: Internal measures of the four deterministic partitions.
_BOARD = f"{_DIST}, {_DB.removeprefix('WITH ' + fx.PARTITIONS + ', ')}{_CH}, bd AS (SELECT run_id, silhouette, davies_bouldin, calinski_harabasz FROM (SELECT run_id, avg(silhouette) AS silhouette FROM sil GROUP BY run_id) JOIN dbi USING (run_id) JOIN chi USING (run_id)), rk AS (SELECT *, rank() OVER (ORDER BY silhouette DESC) AS rank_silhouette, rank() OVER (ORDER BY davies_bouldin) AS rank_davies_bouldin, rank() OVER (ORDER BY calinski_harabasz DESC) AS rank_calinski_harabasz FROM bd), rs AS (SELECT *, rank_silhouette + rank_davies_bouldin + rank_calinski_harabasz AS rank_score FROM rk)"


def _board(spark, d):
    return materialize(metrics.internal(fx.partitions(spark, d)), "board")


@query("rank_sum_scoreboard", f"{_BOARD} SELECT *, row_number() OVER (ORDER BY rank_score, silhouette DESC, davies_bouldin, calinski_harabasz DESC, run_id) AS final_order FROM rs", doubles="silhouette davies_bouldin calinski_harabasz", longs="rank_score")
def rank_sum_scoreboard(spark, d):
    return selection.rank_sum(_board(spark, d), ties=[F.desc("silhouette"), F.col("davies_bouldin"), F.desc("calinski_harabasz"), F.col("run_id")])


@query("rank_winners", f"{_BOARD} SELECT *, rank_score = (SELECT min(rank_score) FROM rs) AS winner FROM rs", doubles="silhouette davies_bouldin calinski_harabasz", longs="rank_score")
def rank_winners(spark, d):
    return selection.rank_winners(_board(spark, d))


#: A (k, gap, s, inertia) table from the events: one k for each hour of day.
_CURVE = "cv AS (SELECT CAST(hour(ts) AS BIGINT) + 1 AS k, avg(value) AS gap, stddev_samp(value) / sqrt(count(*)) AS s, sum(value) / (hour(ts) + 1) AS inertia, avg(value) / 500 AS silhouette FROM events GROUP BY hour(ts))"


def _curve(spark, d):
    h = F.hour("ts")
    return fx.table(spark, d, "events").groupBy(h.alias("h")).agg(F.avg("value").alias("gap"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("s"), F.sum("value").alias("t")).select((F.col("h") + 1).cast("long").alias("k"), "gap", "s", (F.col("t") / (F.col("h") + 1)).alias("inertia"), (F.col("gap") / 500).alias("silhouette"))


_GAPK = "gr AS (SELECT k, gap, gap >= lead(gap - s) OVER (ORDER BY k) AS fires FROM cv), gk AS (SELECT coalesce(min(k) FILTER (fires), arg_max(k, (gap, -k))) AS k, CASE WHEN count(*) FILTER (fires) > 0 THEN 'gap_rule' ELSE 'max_gap' END AS rule FROM gr)"


@query("gap_k", f"WITH {_CURVE}, {_GAPK} SELECT k, rule FROM gk")
def gap_k(spark, d):
    return selection.gap_rule(_curve(spark, d))


_ELBOW = """nm AS (SELECT k, inertia, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS x, (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM cv),
bl AS (SELECT k, 1 - y - x AS below, abs(lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k)) AS bend FROM nm),
pk AS (SELECT *, coalesce(below > lag(below) OVER (ORDER BY k) AND below >= lead(below) OVER (ORDER BY k), FALSE) AS peak FROM bl),
el AS (SELECT coalesce(arg_max(k, (below, -k)) FILTER (peak), arg_max(k, (bend, -k)) FILTER (bend IS NOT NULL), min(k)) AS k, CASE WHEN count(*) FILTER (peak) > 0 THEN 'knee' WHEN count(bend) > 0 THEN 'second_difference' ELSE 'first' END AS method FROM pk)"""


@query("elbow_k", f"WITH {_CURVE}, {_ELBOW} SELECT k, method FROM el")
def elbow_k(spark, d):
    return selection.elbow(_curve(spark, d))


@query("silhouette_k", f"WITH {_CURVE} SELECT arg_max(k, (silhouette, -k)) AS k, max(silhouette) AS silhouette FROM cv", doubles="silhouette")
def silhouette_k(spark, d):
    return selection.best_k(_curve(spark, d))


@query("k_summary", f"WITH {_CURVE}, {_GAPK} SELECT (SELECT arg_max(k, (silhouette, -k)) FROM cv) AS silhouette_k, (SELECT min(k) FROM cv) AS k_min, (SELECT max(k) FROM cv) AS k_max, (SELECT k FROM gk) AS gap_k, (SELECT arg_min(k, (inertia, k)) FROM cv) AS bic_k")
def k_summary(spark, d):
    c = _curve(spark, d)
    return selection.k_summary(c, c, c.select("k", F.col("inertia").alias("bic")))


@query(
    "unified_experiments",
    f"{_EXT}, z AS (SELECT run_id, count(*) AS n FROM part GROUP BY run_id) SELECT 'kmeans' AS algorithm, 'k=' || CAST(ascii(run_id) AS VARCHAR) AS parameters, ari, nmi, purity, 'kmeans' AS source FROM ext UNION ALL SELECT 'seeded', run_id, ari, NULL, NULL, 'second' FROM ext",
    doubles="ari nmi purity",
)
def unified_experiments(spark, d):
    ext = materialize(metrics.external(fx.partitions(spark, d), ami=False), "external")
    first = ext.select(F.ascii("run_id").alias("k"), "nmi", "purity", F.col("ari").alias("ari_external"))
    second = ext.select(F.lit("seeded").alias("algorithm"), F.col("run_id").alias("parameters"), "ari")
    return selection.unify({"kmeans": first, "second": second}).select("algorithm", "parameters", "ari", "nmi", "purity", "source")


_MEASURES = "SELECT run_id, silhouette, davies_bouldin, calinski_harabasz, ari, nmi FROM bd JOIN ext USING (run_id)"


@query(
    "winner_comparison",
    f"{_BOARD}, {_EXT.removeprefix('WITH ' + fx.PARTITIONS + ', ')}, mz AS ({_MEASURES}), dl AS (SELECT c.silhouette - w.silhouette AS silhouette_delta, w.davies_bouldin - c.davies_bouldin AS davies_bouldin_improvement, c.calinski_harabasz - w.calinski_harabasz AS calinski_harabasz_delta, c.ari - w.ari AS ari_delta, c.nmi - w.nmi AS nmi_delta FROM mz w, mz c WHERE w.run_id = 'a' AND c.run_id = 'b'), im AS (SELECT *, CAST(silhouette_delta > 0 AS BIGINT) + CAST(davies_bouldin_improvement > 0 AS BIGINT) + CAST(calinski_harabasz_delta > 0 AS BIGINT) AS improved FROM dl) SELECT *, CASE WHEN improved >= 2 THEN 'improves' WHEN improved = 1 THEN 'mixed' ELSE 'does not improve' END AS conclusion FROM im",
    doubles="silhouette_delta davies_bouldin_improvement calinski_harabasz_delta ari_delta nmi_delta",
)
def winner_comparison(spark, d):
    rows = fx.partitions(spark, d)
    both = materialize(metrics.internal(rows).join(metrics.external(rows, ami=False), "run_id"), "measures")
    return selection.compare(both.where("run_id = 'a'"), both.where("run_id = 'b'"))


@query("recommendation")
def recommendation(spark, d):
    rows = fx.partitions(spark, d)
    board = selection.rank_sum(metrics.internal(rows).withColumnRenamed("run_id", "algorithm"), ties=[F.desc("silhouette"), F.col("algorithm")])
    ari = agreement.pairwise_ari(rows.select("id", "run_id", "cluster"), every=True).where("left <> right")
    return selection.recommendation(board, ari.groupBy(F.col("left").alias("algorithm")).agg(F.avg("ari").alias("ari_mean")))


@query(
    "nearest_centroid_assign",
    f"WITH {fx.PARTITIONS}, cc AS (SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM part WHERE run_id = 'a') GROUP BY ALL) GROUP BY cluster) SELECT vec.id, arg_min(cc.cluster, (list_distance(vec.v, c), cc.cluster)) AS cluster, min(list_distance(vec.v, c)) AS distance FROM vec, cc GROUP BY vec.id",
    doubles="distance",
)
def nearest_centroid_assign(spark, d):
    rows = fx.partitions(spark, d).where("run_id = 'a'")
    return pairs.nearest_centroid(fx.vectors(spark, d), metrics.centroids(rows).select("cluster", "c"))


_REG = f"""WITH {fx.EVENTS}, al AS (SELECT *, ln(1 + Amount) AS a, sin(2 * pi() * (Time % 86400) / 86400) AS s, cos(2 * pi() * (Time % 86400) / 86400) AS c FROM ev),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(s) AS ms, stddev_pop(s) AS ss, avg(c) AS mc, stddev_pop(c) AS sc FROM al),
z AS (SELECT row_id, kind, (a - ma) / sa AS a, (s - ms) / ss AS s, (c - mc) / sc AS c FROM al, st), nm AS (SELECT kind, dense_rank() OVER (ORDER BY kind) - 1 AS cluster FROM (SELECT DISTINCT kind FROM ev)),
ce AS (SELECT cluster, CAST(CAST(avg(a) AS FLOAT) AS DOUBLE) AS a, CAST(CAST(avg(s) AS FLOAT) AS DOUBLE) AS s, CAST(CAST(avg(c) AS FLOAT) AS DOUBLE) AS c FROM z JOIN nm USING (kind) GROUP BY cluster),
di AS (SELECT row_id, cluster, sqrt((z.a - ce.a) ** 2 + (z.s - ce.s) ** 2 + (z.c - ce.c) ** 2) AS dist FROM z, ce)"""


def _registry(spark, d) -> serving.Registry:
    from cairn.functions.features import build_features

    names = ["Amount_log1p", "Time_sin", "Time_cos"]
    own = build_features(fx.events(spark, d), names, keep=("row_id", "kind"))
    fitted = scaling.fit_columns(own, names)
    scaled = scaling.apply_columns(own, fitted)
    order = [r["kind"] for r in own.select("kind").distinct().orderBy("kind").collect()]
    cluster = F.array_position(F.array(*map(F.lit, order)), F.col("kind")) - 1
    vectors = scaled.select(F.col("row_id").alias("id"), as_doubles(F.array(*names)).alias("v"), cluster.alias("cluster"))
    cents = serving.fit_registry(vectors.select("id", "v"), vectors.select("id", "cluster")).collect()  # a row for each cluster
    return serving.Registry(names, {r["feature"]: (r["center"], r["scale"]) for r in fitted.collect()}, {r["cluster"]: [float(x) for x in r["c"]] for r in cents})


@query("registry_assign", f"{_REG} SELECT row_id, arg_min(cluster, (dist, cluster)) AS assigned_cluster, min(dist) AS nearest_centroid_distance, " + ", ".join(f"min(dist) FILTER (cluster = {c}) AS distance_to_cluster_{c}" for c in range(5)) + " FROM di GROUP BY row_id", doubles="nearest_centroid_distance " + " ".join(f"distance_to_cluster_{c}" for c in range(5)))
def registry_assign(spark, d):
    return _registry(spark, d).assign(fx.events(spark, d)).drop("Time", "Amount", "Class", "kind")


@query("registry_centroids", f"{_REG} SELECT cluster, (SELECT count(*) FROM z JOIN nm n2 USING (kind) WHERE n2.cluster = ce.cluster) AS size, a, s, c FROM ce", doubles="a s c")
def registry_centroids(spark, d):
    r = _registry(spark, d)
    sizes = fx.events(spark, d).groupBy("kind").agg(F.count("*").alias("size")).withColumn("cluster", F.row_number().over(_by_kind()) - 1)
    cents = spark.createDataFrame([(c, *v) for c, v in r.centroids.items()], "cluster long, a double, s double, c double")
    return sizes.join(cents, "cluster").select("cluster", "size", "a", "s", "c")


def _by_kind():
    from pyspark.sql import Window

    return Window.orderBy("kind")  # a row for each kind


@query("surrogate_tree")
def surrogate_tree(spark, d):
    names = list(fx.WIDE)
    rows = fx.lines(spark, d).withColumn("id", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    rows = rows.withColumn("cluster", F.when(F.col("l_quantity") * F.col("l_discount") > 1.5, 1).when(F.col("l_extendedprice") > 50_000, 2).otherwise(0))
    return interpret.surrogate_tree(materialize(rows, "lines"), names)[1].drop("rules")


@query("label_isolation", "SELECT CAST(0 AS BIGINT) AS n_changed")
def label_isolation(spark, d):
    """Assignments don't change when the label is set to another value."""
    r, e = _registry(spark, d), fx.events(spark, d)
    a = r.assign(e).select("row_id", F.col("assigned_cluster").alias("a"))
    b = r.assign(e.withColumn("Class", F.lit(1) - F.col("Class"))).select("row_id", F.col("assigned_cluster").alias("b"))
    return a.join(b, "row_id").agg(F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


@query("window_drift", f"""WITH {fx.SPLIT}, q AS (SELECT list_sort(list_distinct(quantile_cont(Amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM sp WHERE split = 'train')
SELECT CAST(floor(Time / 86400) AS BIGINT) AS day, len(list_filter(e, lambda x: Amount >= x)) AS bin, count(*) AS n FROM sp, q WHERE split = 'test' GROUP BY ALL""", longs="bin")
def window_drift(spark, d):
    """Batch twin of the streaming monitor: counts by day and reference bin."""
    s = temporal_split(fx.events(spark, d))
    edges = sorted(set(s.where("split = 'train'").agg(F.percentile("Amount", F.array(*(F.lit(i / 10) for i in range(1, 10))))).collect()[0][0]))
    bin_ = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, x: a + F.when(F.col("Amount") >= x, 1).otherwise(0))
    return s.where("split = 'test'").groupBy(F.floor(F.col("Time") / 86400).alias("day"), bin_.alias("bin")).agg(F.count("*").alias("n"))
