"""Queries of the views that a dashboard shows, and of the tie rules of selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import selection, views
from cairn.operators.hierarchy import MAX_ROWS, cuts_of, trees
from cairn.plans import clusters, fixtures as fx
from cairn.plans.choices import _BOARD, _REG, _board, _registry
from cairn.plans.quality import _LONG, _profile
from cairn.plans.registry import query


def _one(spark, d):
    return fx.partitions(spark, d, (fx.RUNS[0],))


_A = f"WITH {fx.PARTITIONS}"


@query("dashboard_overview", f"{_A} SELECT (SELECT count(*) FROM events) AS records, count(*) AS sample, count(DISTINCT cluster) AS clusters, max(len(v)) AS dimensions FROM part WHERE run_id = 'a'", longs="records sample clusters dimensions")
def dashboard_overview(spark, d):
    own = _one(spark, d)
    return views.overview(fx.table(spark, d, "events"), own, own)


@query("dashboard_sizes", f"{_A} SELECT cluster, count(*) AS size, count(*) / sum(count(*)) OVER () AS share FROM part WHERE run_id = 'a' GROUP BY cluster", doubles="share", longs="size")
def dashboard_sizes(spark, d):
    return views.sizes(_one(spark, d))


@query("dashboard_points", f"{_A} SELECT id, cluster, v[1] AS x, v[2] AS y, label FROM part WHERE run_id = 'a' AND cluster IN (0, 2) ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 2500", doubles="x y")
def dashboard_points(spark, d):
    """The explorer's points: two chosen clusters, 2,500 points at most (the plot's bound), with the label as a fact."""
    own = _one(spark, d)
    return views.points(own.select("id", "v"), own, own.select("id", "label"), clusters=(0, 2))


@query("dashboard_deviations", f"{_LONG} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature) AS position, feature, z FROM pf QUALIFY position <= 15", doubles="z", longs="cluster position")
def dashboard_deviations(spark, d):
    return views.deviations(_profile(spark, d))


@query(
    "dashboard_measures",
    f"{_BOARD} SELECT run_id AS algorithm, metric, value FROM (SELECT run_id, silhouette, davies_bouldin, calinski_harabasz FROM rs) UNPIVOT (value FOR metric IN (silhouette, davies_bouldin, calinski_harabasz))",
    doubles="value",
)
def dashboard_measures(spark, d):
    return views.side_by_side(_board(spark, d).withColumnRenamed("run_id", "algorithm"))


@query("dashboard_distances", f"{_REG} SELECT row_id, cluster, dist AS distance, cluster = arg_min(cluster, (dist, cluster)) OVER (PARTITION BY row_id) AS nearest FROM di", doubles="distance", longs="cluster")
def dashboard_distances(spark, d):
    """Every event's distance to each cluster of the registry."""
    return views.distances(_registry(spark, d).assign(fx.events(spark, d)))


def _ranked(partition: str) -> str:
    """SQL of competition ranks of the result table's measures within ``partition``."""
    over = lambda c: f"rank() OVER ({partition}ORDER BY {c})"
    return f"SELECT *, rank_silhouette + rank_davies_bouldin + rank_calinski_harabasz AS rank_score FROM (SELECT *, {over('silhouette DESC')} AS rank_silhouette, {over('davies_bouldin')} AS rank_davies_bouldin, {over('calinski_harabasz DESC')} AS rank_calinski_harabasz FROM res WHERE silhouette IS NOT NULL AND davies_bouldin IS NOT NULL AND calinski_harabasz IS NOT NULL)"


#: A result row for each part, with coarse measures so that ranks tie, some of them missing: (id, metric, requested_k, measures).
_RESULTS = """WITH res AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'euclidean' ELSE 'manhattan' END AS metric, 2 + p_partkey % 7 AS requested_k,
CASE WHEN p_partkey % 11 <> 0 THEN p_size % 10 / 10.0 END AS silhouette, CASE WHEN p_partkey % 13 <> 0 THEN 1 + p_partkey % 5 / 5.0 END AS davies_bouldin, floor(p_retailprice / 100) AS calinski_harabasz FROM part)"""
_MEASURED = {"doubles": "silhouette davies_bouldin calinski_harabasz", "longs": "requested_k rank_silhouette rank_davies_bouldin rank_calinski_harabasz rank_score final_order"}


def _results(spark, d):
    key, m = F.col("p_partkey"), lambda n: F.col("p_partkey") % n
    return fx.table(spark, d, "part").select(
        key.alias("id"),
        F.when(m(2) == 0, "euclidean").otherwise("manhattan").alias("metric"),
        (m(7) + 2).alias("requested_k"),
        F.when(m(11) != 0, F.col("p_size") % 10 / 10.0).cast("double").alias("silhouette"),
        F.when(m(13) != 0, 1 + m(5) / 5.0).cast("double").alias("davies_bouldin"),
        F.floor(F.col("p_retailprice") / 100).cast("double").alias("calinski_harabasz"),
    )


@query("rank_smaller_k", f"{_RESULTS} SELECT *, row_number() OVER (ORDER BY rank_score, silhouette DESC, requested_k, id) AS final_order FROM ({_ranked('')})", **_MEASURED)
def rank_smaller_k(spark, d):
    """The rule of consensus searches: equal sums of ranks go to the better silhouette, then to the smaller k."""
    return selection.rank_sum(_results(spark, d), ties=[F.desc("silhouette"), F.col("requested_k"), F.col("id")])


@query("rank_by_metric", f"{_RESULTS} SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rank_score, silhouette DESC, requested_k, id) AS final_order FROM ({_ranked('PARTITION BY metric ')})", **_MEASURED)
def rank_by_metric(spark, d):
    """The same rule within each distance metric."""
    return selection.rank_sum(_results(spark, d), partition=["metric"], ties=[F.desc("silhouette"), F.col("requested_k"), F.col("id")])


@query("best_of_each_metric", f"{_RESULTS} SELECT * FROM ({_ranked('PARTITION BY metric ')}) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY rank_score, silhouette DESC, requested_k, id) = 1", doubles=_MEASURED["doubles"], longs=_MEASURED["longs"].removesuffix(" final_order"))
def best_of_each_metric(spark, d):
    return selection.best_in(_results(spark, d), ["metric"], ties=[F.desc("silhouette"), F.col("requested_k"), F.col("id")])


@query("hierarchy_final")
def hierarchy_final(spark, d):
    """The final fit: every linkage's cuts of a sample of 6,000 rows (of all rows, where there are fewer)."""
    return cuts_of(trees(clusters._sample(spark, d, MAX_ROWS), ks=range(2, 9)))
