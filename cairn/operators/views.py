"""What a dashboard shows, as tables. Views are plans over written results; what reaches a page has a bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cairn.operators.cleaning import hash_sample
from cairn.operators.profiling import unpivot

#: Points of a scatter plot.
SHOWN = 2_500
MEASURES = ("silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi", "ami")


def overview(clean: DataFrame, assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: records, sampled records, clusters, and dimensions of the vectors ``v``."""
    sample = assignments.agg(F.count("*").alias("sample"), F.count_distinct("cluster").alias("clusters"))
    wide = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dimensions"))
    return clean.agg(F.count("*").alias("records")).crossJoin(sample).crossJoin(wide)  # one row each


def sizes(assignments: DataFrame) -> DataFrame:
    """(cluster, size, share)."""
    own = assignments.groupBy("cluster").agg(F.count("*").alias("size"))
    return own.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy()))  # a row for each cluster


def points(rows: DataFrame, assignments: DataFrame, facts: DataFrame | None = None, clusters: Sequence[int] | None = None, shown: int = SHOWN, seed: int = 42) -> DataFrame:
    """(id, cluster, x, y, and the facts by id) of at most ``shown`` rows of the chosen clusters: the first two components.

    Rows are drawn by the order of their ids' hashes, so the same choice shows the same points. Vectors and facts
    are met by the drawn ids alone.
    """
    chosen = assignments if clusters is None else assignments.where(F.col("cluster").isin(list(clusters)))
    drawn = F.broadcast(hash_sample(chosen.select("id", "cluster"), shown, seed, "id"))  # ``shown`` rows at most
    out = rows.select("id", "v").join(drawn, "id").select("id", "cluster", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
    return out if facts is None else out.join(facts, "id", "left")


def deviations(profile: DataFrame, n: int = 15) -> DataFrame:
    """(cluster, position, feature, z): each cluster's ``n`` features farthest from the whole."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "feature")  # a row for each feature
    return profile.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= n).select("cluster", "position", "feature", "z")


def side_by_side(results: DataFrame, measures: Sequence[str] = MEASURES, name: str = "algorithm") -> DataFrame:
    """(algorithm, metric, value) of the measures that the result table has, without nulls."""
    return unpivot(results, [m for m in measures if m in results.columns], (name,), "metric").where("value is not null")


def drift_order(report: DataFrame) -> DataFrame:
    """The drift report with its features' places by falling PSI."""
    return report.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("psi"), "feature")).cast("long"))  # a row for each feature


def distances(assigned: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, cluster, distance, nearest) of assigned rows: the columns distance_to_cluster_<id> made rows."""
    start = "distance_to_cluster_"
    own = sorted((int(c.removeprefix(start)) for c in assigned.columns if c.startswith(start)))
    if not own:
        raise ValueError("the rows have no distances: assign them first")
    boxed = F.array(*(F.struct(F.lit(c).cast("long").alias("cluster"), F.col(f"{start}{c}").alias("distance")) for c in own))
    return assigned.select(key, "assigned_cluster", F.inline(boxed)).select(key, "cluster", "distance", (F.col("cluster") == F.col("assigned_cluster")).alias("nearest"))
