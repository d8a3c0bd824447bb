"""Standard and robust scaling, and principal components, as parameter tables over a vector column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions.vectors import matrix
from cairn.operators.profiling import quantile, unpivot
from cairn.operators.quantiles import exact_quantiles


def explode_vector(rows: DataFrame, vector: str = "v", ids: tuple[str, ...] = ()) -> DataFrame:
    """(ids, dim, value) of a vector column."""
    return rows.select(*ids, F.posexplode(vector).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.col("value").cast("double"))


def fit_standard(rows: DataFrame, vector: str = "v") -> DataFrame:
    """(dim, center, scale): mean and population deviation; a constant keeps scale 1."""
    out = explode_vector(rows, vector).groupBy("dim").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def fit_robust(rows: DataFrame, vector: str = "v", accuracy: int | None = None) -> DataFrame:
    """(dim, center, scale): median and interquartile range (exact, or from a sketch); a constant keeps scale 1."""
    long, shares = explode_vector(rows, vector), [0.25, 0.5, 0.75]
    out = long.groupBy("dim").agg(quantile("value", shares, accuracy).alias("q")) if accuracy else exact_quantiles(long, ["dim"], "value", shares)
    spread = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    return out.select("dim", F.get("q", F.lit(1)).alias("center"), F.when(spread > 0, spread).otherwise(1.0).alias("scale"))


def apply_scaler(rows: DataFrame, parameters: DataFrame, vector: str = "v") -> DataFrame:
    """The vector column scaled, as one projection; the parameters (a row for each dimension) become literals."""
    got = sorted((r["dim"], r["center"], r["scale"]) for r in parameters.collect())
    center, scale = F.array(*(F.lit(c) for _, c, _ in got)), F.array(*(F.lit(s) for _, _, s in got))
    moved = F.zip_with(F.transform(F.col(vector), lambda x: x.cast("double")), center, lambda x, c: x - c)
    return rows.withColumn(vector, F.zip_with(moved, scale, lambda x, s: x / s))


def fit_columns(rows: DataFrame, columns: list[str], robust: bool = False, accuracy: int | None = None) -> DataFrame:
    """(feature, center, scale) of named columns."""
    long = unpivot(rows, columns)
    if robust:
        shares = [0.25, 0.5, 0.75]
        q = long.groupBy("feature").agg(quantile("value", shares, accuracy).alias("q")) if accuracy else exact_quantiles(long, ["feature"], "value", shares)
        q = q.select("feature", F.get("q", F.lit(1)).alias("center"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("scale"))
    else:
        q = long.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    return q.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def apply_columns(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    got = parameters.collect()  # a row for each feature
    return rows.withColumns({r["feature"]: (F.col(r["feature"]).cast("double") - F.lit(r["center"])) / F.lit(r["scale"]) for r in got})


def pivot_row(rows: DataFrame, vector: str = "v") -> np.ndarray:
    """Any row's vector: sums about it lose no digits far from the origin."""
    got = rows.select(vector).where(F.col(vector).isNotNull()).first()
    return np.array(got[0] if got else [], np.float64)


def moments(rows: DataFrame, vector: str = "v", pivot: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products of the rows less ``pivot``; each task sends d * d numbers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            x = x if pivot is None else x - pivot
            n, s, ss = n + len(x), (0 if s is None else s) + x.sum(0), (0 if ss is None else ss) + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    parts = rows.select(vector).mapInArrow(run, "n long, s array<double>, ss array<double>")
    long = parts.select(F.explode(F.arrays_zip(F.concat(F.array(F.col("n").cast("double")), "s", "ss").alias("x"), F.sequence(F.lit(0), F.size("s") + F.size("ss")).alias("i"))).alias("z"))
    sums = {r["i"]: r["x"] for r in long.groupBy(F.col("z.i").alias("i")).agg(F.sum("z.x").alias("x")).collect()}  # 1 + d + d * d rows
    if not sums:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + (1 + 4 * (len(sums) - 1)) ** 0.5) / 2))
    flat = np.array([sums[i] for i in range(len(sums))])
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def mean_and_covariance(rows: DataFrame, vector: str = "v", less: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance over n - ``less``, and n, from sums about a pivot row."""
    pivot = pivot_row(rows, vector)
    n, s, ss = moments(rows, vector, pivot)
    off = s / max(n, 1)
    return (pivot + off if n else off), (ss - n * np.outer(off, off)) / max(n - less, 1), n


def fit_pca(rows: DataFrame, vector: str = "v", variance: float = 0.95, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(mean, loadings, variance shares, components kept): the first that reach ``variance`` together.

    The sign of a component makes its largest loading positive.
    """
    mean, covariance, n = mean_and_covariance(rows, vector)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, loadings = np.maximum(values[order], 0), vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])[:, None]
    share = values / values.sum() if values.sum() else values
    kept = min(int(np.searchsorted(np.cumsum(share), variance) + 1), len(share), most or len(share))
    return mean, loadings, share, kept


def pca_table(rows: DataFrame, vector: str = "v", variance: float = 0.95) -> DataFrame:
    """(component, share, cumulative, kept)."""
    _, _, share, kept = fit_pca(rows, vector, variance)
    shares = rows.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(share)], "component long, share double")
    return shares.withColumn("cumulative", F.sum("share").over(Window.orderBy("component"))).withColumn("kept", F.col("component") <= kept)


def apply_pca(rows: DataFrame, mean: np.ndarray, loadings: np.ndarray, kept: int, vector: str = "v") -> DataFrame:
    """The vector column centred and projected."""
    names = rows.columns
    at = names.index(vector)
    basis = loadings[:kept].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (matrix(batch.column(at)) - mean) @ basis if len(batch) else np.zeros((0, kept))
            own = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), kept).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([own if i == at else c for i, c in enumerate(batch.columns)], names)

    double = rows.withColumn(vector, F.transform(vector, lambda x: x.cast("double")))
    return double.mapInArrow(run, double.schema)
