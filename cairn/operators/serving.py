"""The assignment registry: fitted parameters as tables, and batch or streaming assignment by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions.features import build_features


def fit_registry(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, size, c): centroids of (id, v) by (id, cluster), in single precision. No label takes part."""
    long = vectors.join(clusters, "id").select("cluster", "id", F.posexplode("v").alias("dim", "x"))
    means = long.groupBy("cluster", "dim").agg(F.avg("x").cast("float").alias("x"), F.count("*").alias("size"))
    return means.groupBy("cluster").agg(F.max("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("c"))


def save_registry(path: str, centroids: DataFrame, scaler: DataFrame, features: Sequence[str], loadings: np.ndarray | None = None, mean: np.ndarray | None = None) -> None:
    """Parameter tables below ``path``: centroids, scaler, features, and components where there are some."""
    spark = centroids.sparkSession
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame(list(enumerate(features)), "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")
    rows = [] if loadings is None else [(i, [float(x) for x in r]) for i, r in enumerate(loadings)] + [(-1, [float(x) for x in mean])]
    spark.createDataFrame(rows, "component int, loading array<double>").write.mode("overwrite").parquet(f"{path}/components")


class Registry:
    """Fitted parameters, small enough to be literals of a projection."""

    def __init__(self, features: Sequence[str], scaler: dict[str, tuple[float, float]], centroids: dict[int, list[float]], components: list[list[float]] | None = None, mean: list[float] | None = None):
        self.features, self.scaler, self.centroids, self.components, self.mean = list(features), scaler, centroids, components, mean

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        read = lambda name: spark.read.parquet(f"{path}/{name}").collect()  # noqa: E731  parameter tables
        features = [r["feature"] for r in sorted(read("features"), key=lambda r: r["position"])]
        parts = {r["component"]: list(r["loading"]) for r in read("components")}
        mean = parts.pop(-1, None)
        return cls(features, {r["feature"]: (r["center"], r["scale"]) for r in read("scaler")}, {r["cluster"]: [float(x) for x in r["c"]] for r in read("centroids")}, [parts[i] for i in sorted(parts)] or None, mean)

    def vector(self) -> list[Column]:
        """The scaled (and projected) coordinates as plain arithmetic on the feature columns."""
        x = [(F.col(f) - F.lit(self.scaler[f][0])) / F.lit(self.scaler[f][1]) for f in self.features]
        if self.components is None:
            return x
        moved = [a - F.lit(m) for a, m in zip(x, self.mean)]
        return [sum((a * F.lit(w) for a, w in zip(moved, row)), F.lit(0.0)) for row in self.components]

    def assign(self, rows: DataFrame, key: Sequence[str] = ("row_id",), time: str = "Time", amount: str = "Amount") -> DataFrame:
        """The input's columns, assigned_cluster, nearest_centroid_distance and distance_to_cluster_<id>: a narrow
        projection without a shuffle, so it serves a stream as it is. Ties go to the smaller cluster."""
        keep = list(rows.columns)
        built = build_features(rows.select("*", F.struct(*keep).alias("_row")), self.features, time, amount, ["_row"])
        placed = built.select("_row", F.array(*self.vector()).alias("_v"))
        names = sorted(self.centroids)
        far = {c: F.sqrt(F.aggregate(F.zip_with("_v", F.array(*(F.lit(float(x)) for x in self.centroids[c])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in names}
        out = placed.select("_row", *(d.alias(f"distance_to_cluster_{c}") for c, d in far.items()))
        nearest = F.array_min(F.array(*(F.struct(F.col(f"distance_to_cluster_{c}").alias("d"), F.lit(c).alias("c")) for c in names)))
        out = out.withColumn("_best", nearest)
        return out.select(*(F.col(f"_row.{c}").alias(c) for c in keep), F.col("_best.c").alias("assigned_cluster"), F.col("_best.d").alias("nearest_centroid_distance"), *(f"distance_to_cluster_{c}" for c in names))
